"""The near-dedup stage at its threshold: pairs of known similarity, links verified exactly."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("xxhash")
from assayline.llm import simhash  # noqa: E402

WORDS = [f"w{i}" for i in range(5000)]


def _changed(text: list[str], places: range, mark: str) -> list[str]:
    """``text`` with single words replaced: each place at least five words from the next takes five shingles."""
    return [f"{mark}{i}" if i in places else w for i, w in enumerate(text)]


def _groups(spark, rows):
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(frame).collect()}


def test_pairs_at_the_threshold_are_found(spark):
    pick, rows = random.Random(1), []
    for k in range(300):
        text = [pick.choice(WORDS) for _ in range(454)]  # 450 shingles; 400 of 500 stay
        rows += [(2 * k, text), (2 * k + 1, _changed(text, range(10, 410, 40), "x"))]
    found = _groups(spark, rows)
    assert sum(found[2 * k + 1] == 2 * k for k in range(300)) >= 294
    bands = simhash.choose_bands(100_000)
    assert simhash.band_recall(bands.shape[1], len(bands)) >= 0.99


def test_pairs_under_the_threshold_stay(spark):
    pick, rows = random.Random(2), []
    for k in range(100):
        text = [pick.choice(WORDS) for _ in range(459)]  # 455 shingles; 390 of 520 stay: 0.75
        rows += [(2 * k, text), (2 * k + 1, _changed(text, range(10, 400, 30), "x"))]
    found = _groups(spark, rows)
    assert all(found[i] == i for i, _ in rows)


def test_members_of_a_family_are_compared_with_each_other(spark):
    pick, rows = random.Random(3), []
    for k in range(40):
        text = [pick.choice(WORDS) for _ in range(459)]
        other = _changed(text, range(10, 400, 30), "x")  # 0.75 to the first
        rows += [(3 * k, text), (3 * k + 1, other), (3 * k + 2, _changed(other, range(405, 425, 10), "y"))]  # 0.96 to the second
    found = _groups(spark, rows)
    assert all((found[3 * k], found[3 * k + 1], found[3 * k + 2]) == (3 * k, 3 * k + 1, 3 * k + 1) for k in range(40))


def test_families_are_joined_as_by_comparing_all_pairs(spark, monkeypatch):
    """One large family whose members are mostly under the threshold to each other, in several blocks."""
    monkeypatch.setattr(simhash, "BLOCK_SETS", 30)
    pick = random.Random(4)
    text = [pick.choice(WORDS) for _ in range(204)]
    rows = [(i, [f"{i}-{k}" if pick.random() < 0.025 else w for k, w in enumerate(text)]) for i in range(160)]
    sets = [set(zip(*(t[k:] for k in range(5)))) for _, t in rows]
    up = list(range(160))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(160):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    found = _groups(spark, rows)
    expected = {i: root(i) for i in range(160)}
    assert 1 < len(set(expected.values())) < 160 and found == expected

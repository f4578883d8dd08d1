"""Passages of part of a benchmark item, items with spread edits, and items too short for the q-gram lemma with q = 8."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import decontaminate


def _words(pick, n, letters="abcdefghij"):
    return ["".join(pick.choice(letters) for _ in range(pick.randint(2, 8))) for _ in range(n)]


def _found(index, text):
    return index.matches(decontaminate.code_points(text))


def test_every_passage_of_thirteen_words():
    pick = random.Random(1)
    item = _words(pick, 45)
    index = decontaminate.Windows([(1, " ".join(item))])
    for at in range(45 - 13 + 1):
        around = " ".join(_words(pick, 60, "klmnopqrst"))
        found = _found(index, f"{around} {' '.join(item[at : at + 13])} {around}")
        assert found and found[0][1] == 0
        assert not _found(index, f"{around} {' '.join(item[at : at + 6])} {around}")


def test_passages_of_an_item_without_spaces():
    pick = random.Random(2)
    item = "".join(chr(pick.randrange(0x4E00, 0x9000)) for _ in range(400))
    index = decontaminate.Windows([(1, item)])
    for at in range(0, 300, 7):
        assert _found(index, "ab " * 50 + item[at : at + 100] + " cd" * 50)


@pytest.mark.parametrize("sign", ["insert", "delete"])
def test_spread_edits_at_the_full_budget(sign):
    pick, missed = random.Random(3), 0
    for k in range(200):
        item = "".join(pick.choice("abcdefghij") for _ in range(96))
        index, edited = decontaminate.Windows([(1, item)]), list(item)
        for p in range(88, 7, -10):  # nine edits, ten characters apart: two or three q-grams stay between them
            edited[p : p + 1] = [edited[p], "x"] if sign == "insert" else []
        missed += not _found(index, "y" * (50 + k) + "".join(edited) + "z" * 50)
    assert missed == 0


@pytest.mark.parametrize("length", [3, 7, 10, 12, 15, 20, 23, 30, 31])
def test_short_items(length):
    pick = random.Random(4)
    for _ in range(20):
        item = "".join(pick.choice("abcdefghij") for _ in range(length))
        index, edited = decontaminate.Windows([(1, item)]), list(item)
        k = int(length * decontaminate.ERROR_RATE)
        for n in range(k):
            edited[(n + 1) * length // (k + 1)] = "x"
        assert _found(index, "y" * 40 + "".join(edited) + "z" * 40)
        assert not _found(index, "yz" * 40)


def _edits(window: str, text: str) -> int:
    """Fewest edits between the window and any part of the text."""
    codes, at = decontaminate.code_points(text), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for c in map(ord, window):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (codes != c))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def _contaminated(docs, items):
    """{(doc_id, item_id): fewest edits} by comparing every window with every text."""
    out = {}
    for doc_id, text in docs:
        for item_id, item in items:
            item, normal = decontaminate.normal(item), decontaminate.normal(text)
            for window in {item[a:b] for a, b in decontaminate.window_spans(item)} if item and normal else ():
                edits = _edits(window, normal)
                if edits <= int(len(window) * decontaminate.ERROR_RATE):
                    out[doc_id, item_id] = min(edits, out.get((doc_id, item_id), edits))
    return out


@pytest.mark.parametrize(("block", "hits", "lengths"), [(4_000_000, 1 << 20, (1 << 16, 1 << 11)), (150, 64, (1_024, 950))])
def test_query_equals_comparing_every_window(spark, monkeypatch, block, hits, lengths):
    """Also in several blocks, and in slices as small as they may be."""
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    monkeypatch.setattr(decontaminate, "HITS", hits)
    monkeypatch.setattr(decontaminate, "SLICE", lengths[0])
    monkeypatch.setattr(decontaminate, "LEAST_SLICE", lengths[1])
    pick = random.Random(5)
    items = [(k, " ".join(_words(pick, n))) for k, n in enumerate((4, 14, 20, 9))]
    items += [(None, " ".join(_words(pick, 14))), (None, "unheard of"), (1, " ".join(_words(pick, 14))), (7, None), (8, ""), (9, "tick tock " * 12), (10, "=" * 300)]
    docs = [(None, "nothing"), (90, None), (91, ""), (92, "tick tock tick tack " * 9), (93, "tick tock " * 60), (94, "=" * 400), (95, "=-" * 150)]
    for k in range(24):
        words = (items[k % 7][1] or "").split()
        at = pick.randrange(max(1, len(words) - 13))
        part = list(" ".join(words[at : at + pick.choice((6, 13, 20))]))
        for _ in range(pick.choice((0, 0, 2, 5, 12))):
            p = pick.randrange(len(part))
            part[p : p + 1] = pick.choice(["x", "", "xy"])
        docs.append((k, f"{' '.join(_words(pick, 20, 'klmnop'))} {''.join(part)} {' '.join(_words(pick, pick.choice((5, 200)), 'klmnop'))}"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "item_id": F.lit(2), "best": F.lit("x")})
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = [(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_contamination(frame, benchmark).collect()]
    want = _contaminated(docs, items)
    index = decontaminate.Windows([(i, decontaminate.normal(t)) for i, t in items])  # here, where the slices are small
    assert {(d, index.item[w], e) for d, t in docs for w, e, *_ in _found(index, decontaminate.normal(t))} == {(*k, v) for k, v in want.items()} | {
        (d, 1, e) for d, t in docs for w, e, *_ in _found(index, decontaminate.normal(t)) if index.item[w] == 1
    }
    assert sorted(found, key=repr) == sorted(((*k, v) for k, v in want.items()), key=repr) and len(found) > 10
    kept = decontaminate.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((d for d, _ in docs if not any(d == x for x, _ in want)), key=repr)


def test_texts_and_items_of_one_word():
    """A million characters against as many: in seconds, and in little memory."""
    import tracemalloc

    text = decontaminate.code_points(("word " * 200_000).strip())
    index = decontaminate.Windows([(1, ("word " * 200_000).strip()), (2, "-" * 500_000)])
    tracemalloc.start()
    assert _found(index, ("word " * 200_000).strip()) == [(0, 0, 0, 64)]
    assert _found(index, "-" * 1_000_000)[0][1] == 0
    assert _found(index, "-=" * 300_000) == []
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert len(text) == 999_999 and len(index.of) == 2

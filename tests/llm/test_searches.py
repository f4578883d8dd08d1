"""Hard negatives, near-duplicate vectors and ranked search against brute force, in small blocks and on awkward rows."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import lexical, negatives, smallworld

VECTORS = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


# --- hard negatives


def mined(rows):
    """The contract of hard negatives, row by row in whole numbers."""
    usable = {}
    for vec_id, vector, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        usable.setdefault(vec_id, ([math.floor(256 * x) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for a, (va, la) in usable.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, (v, lab) in usable.items() if i != a and len(v) == len(va))
        for s, i, _ in [x for x in scored if x[2] == la][:5]:
            inside = [(t, j) for t, j, lab in scored if lab != la and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(inside[:10])]
    return sorted(out)


def vectors(n, dim, seed=1, labels=3):
    random = np.random.default_rng(seed)
    return [(i, random.standard_normal(dim).round(3).tolist(), int(random.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 21, 16])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", block)
    rows = vectors(620, 6) + [(700 + i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], i % 2) for i in range(60)]  # ties
    found = negatives.negatives_query(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, found)) == mined(rows)


def test_negatives_of_odd_rows(spark):
    good = vectors(40, 3, 2)
    odd = [(100, None, 1), (200, [1.0, None, 2.0], 1), (300, [NAN, 1.0, 1.0], 1), (400, [INF, 1.0, 1.0], 1), (500, [1.0, 2.0], 1), (501, [1.0, 3.0], 1), (502, [0.5, 1.0], 2), (None, [1.0, 1.0, 1.0], 1), (41, [1.0, 1.0, 1.0], None)]
    odd += [(600, [], 1), (601, [], 1), (602, [], 2), (3, [9.0, 9.0, 9.0], 9), good[5], good[5]]
    frame = spark.createDataFrame(good + odd, VECTORS).withColumns({"vector": F.lit(1), "own": F.lit("x"), "anchor_id": F.lit(2)})
    assert sorted(map(tuple, negatives.negatives_query(frame).collect())) == mined(good + odd)
    assert negatives.negatives_query(frame.limit(0)).count() == 0


def test_negatives_of_huge_components(spark):
    """Scores beyond 2^53 are exact; beyond 64 bits they are the largest number."""
    rows = [(0, [3e6, 1.0], 0), (1, [2.5e6, -3.0], 1), (2, [1.5e6, 7.25], 2), (3, [1.5e6, 7.5], 2), (4, [1.500000001e6, 7.5], 3)]
    found = negatives.negatives_query(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, found)) == mined(rows) and len(found) == 3
    more = [*rows, (5, [1e300, 1.0], 1)]
    assert {(r["positive_id"], r["positive_score"]) for r in negatives.negatives_query(spark.createDataFrame(more, VECTORS)).collect()} <= {(1, found[0]["positive_score"]), (5, (1 << 63) - 1)}


# --- near-duplicate vectors


def linked(rows, least=0.9):
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for k in good:
        for j in good:
            if j != k and len(rows[k][1]) == len(rows[j][1]):
                a, b = np.array(rows[k][1]), np.array(rows[j][1])
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    near[k].add(j)
    component = {k: i for k, (i, _) in enumerate(rows)}
    moved = True
    while moved:
        moved = False
        for k in near:
            low = min(component[j] for j in (k, *near[k]))
            if low < component[k]:
                component[k], moved = low, True
    return Counter((i, len(near[k]), component[k], component[k] == i) for k, (i, _) in enumerate(rows))


def groups(seed=3, dim=24):
    """Loose vectors, chains of neighbours, and a dense group."""
    random = np.random.default_rng(seed)
    out = [random.standard_normal(dim) for _ in range(500)]
    for k in range(60):
        out.append(out[k] + 0.3 * random.standard_normal(dim))
    center = random.standard_normal(dim)
    out += [center + 0.08 * random.standard_normal(dim) for _ in range(240)]
    out += [out[3], out[3], 2 * out[3]]
    return [(int(i), v.tolist()) for i, v in zip(random.permutation(len(out)), out)]


@pytest.mark.parametrize("shard", [65_536, 128])
def test_links_equal_brute_force(spark, monkeypatch, shard):
    """Also with beams that start too narrow and a graph of several shards."""
    monkeypatch.setattr(smallworld, "SHARD", shard)
    rows = groups()
    found = smallworld.near_duplicates(spark.createDataFrame(rows, "vec_id long, vector array<double>"), 0.9).collect()
    assert Counter(map(tuple, found)) == linked(rows)


def test_graph_finds_what_a_scan_finds():
    random = np.random.default_rng(5)
    points = np.arange(3_000)
    levels = smallworld._levels(points)
    order = np.lexsort([points, -levels])
    wide = smallworld.unit(random.standard_normal((3_000, 16)))
    graph = smallworld.SmallWorld.build(wide.astype(np.float32), levels[order])
    assert [len(x) for x in graph.links] == [(levels >= k).sum() for k in range(levels.max() + 1)]
    queries = smallworld.unit(wide + 0.1 * random.standard_normal(wide.shape)).astype(np.float32)
    width = graph.audited(queries, 0.9)
    assert width <= smallworld.WIDEST
    want = (queries @ graph.vectors.T >= 0.9).sum()
    assert sum(len(x) for _, x in graph.within(queries, 0.9, width)) >= 0.99 * want


def test_links_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1e200, 1e199]), (10, [1e-200, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [-1.0, 0.0]), (12, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"h": F.lit(1), "point": F.lit(2), "component": F.lit(3), "n_links": F.lit(4)})
    want = Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 1, (5, 0, 5, True): 1, (6, 0, 6, True): 1, (None, 0, None, True): 1, (7, 4, 7, True): 1, (8, 4, 7, False): 2, (9, 4, 7, False): 1, (10, 4, 7, False): 1, (11, 0, 11, True): 1, (12, 0, 12, True): 2})
    assert Counter(map(tuple, smallworld.smallworld_query(frame).collect())) == want
    assert smallworld.smallworld_query(frame.limit(0)).count() == 0


# --- ranked search


def ranked(docs, items, k=50):
    words = lambda text: re.findall(lexical.TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i].update(words(t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


WORDS = "the of Größe and señor naïve x1 42 zeta over under words it's 日本 語 long tail".split()


@pytest.mark.parametrize(("block", "window"), [(500_000, 1 << 14), (7, 16)])
def test_ranking_equals_brute_force(spark, monkeypatch, block, window):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "WINDOW", window)
    random = np.random.default_rng(7)
    text = lambda n: " ".join(random.choice(WORDS, n).tolist()) + random.choice([".", "\n", "!? "])
    docs = [(int(d), text(int(random.integers(1, 40)))) for d in random.permutation(300)]
    docs += [(i, "zeta and zeta") for i in range(1_000, 1_080)] + [(None, "zeta and zeta"), (5, "The UNDER"), (5, "The UNDER"), (2_000, None), (2_001, ""), (2_002, "--- !!")]
    items = [(i, text(6)) for i in range(12)] + [(None, "zeta"), (20, None), (21, "..."), (22, "absent"), (3, "NAÏVE naïve Zeta"), (23, "zeta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("x"), "score": F.lit(3)}).repartition(5)
    found = lexical.lexical_query(frame, spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("zeta")))
    assert Counter(map(tuple, found.collect())) == ranked(docs, items)


def test_ranking_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.lexical_query(docs, items.limit(0)).count() == 0
    assert lexical.lexical_query(docs.limit(0), items).count() == 0


def test_terms_of_long_texts(monkeypatch):
    data = ("Words, LIKE_these Ünd " * 5_000).encode()
    whole = [t for run in lexical.terms_of(data) for t in run]
    monkeypatch.setattr(lexical, "CHUNK", 7)
    assert [t for run in lexical.terms_of(data) for t in run] == whole == [t.encode() for t in ["words", "like", "these", "Ünd"] * 5_000]


def test_very_long_and_repetitive_documents(spark):
    docs = [(1, "same " * 400_000), (2, "Same other"), (3, "x" * 3_000_000)]
    items = [(1, "same"), (2, "other")]
    found = lexical.lexical_query(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, found.collect())) == ranked(docs, items)

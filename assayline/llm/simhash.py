"""SimHash near-dedup over vantage-point trees.

Fingerprints: each bit is the majority over the 64-bit hashes of a text's word shingles. Equal fingerprints are one
point. A vantage-point tree, fitted on a bounded sample of the points, splits them by Hamming distance: points at most
``mu`` from the vantage point go in, the others out, and points so near the boundary that a partner may lie across it
go to both sides. Every pair within the radius therefore meets in some leaf, and the leaf is searched exactly: it is
split further by local vantage points, then balls are taken off around vantage points, and the triangle bounds decide
which points need comparing at all. A leaf returns one link per point, to its local root, never its pairs; the
components of those links are the groups.

The tree prunes while the radius is small against the spread of distances (4 bits for 64). Similarity 0.8 needs a radius
of 22 % of the bits, where no branch can be pruned, so ``near_duplicate_groups`` shards 256-bit fingerprints of shingle
sets by bands (random choices of bits that overlap), enough of them that a pair at 0.8 shares one with probability
BAND_RECALL, and searches each band's bucket. What the buckets chain together is a family; the shingle sets of a
family are compared exactly, and only similar ones become links. A large family is dealt out in blocks, every pair of
blocks to a task of its own; a task returns links that join what is similar, at most one for each set, never its pairs.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and link like any others; a null
doc_id has a fingerprint, and its group's smallest doc_id that is not null (null if there is none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import materialise, shared_folder
from assayline.llm.components import components

SEED = 42
SAMPLE_POINTS = 16_384
LEAF_POINTS = 4_096
LOCAL_POINTS = 1_024
#: Points that a band's bucket holds on average if bits are even, the fewest bits of a band, and the share of pairs at
#: similarity 0.8 that meet in some band.
BUCKET_POINTS, BAND_BITS, BAND_RECALL = 512, 12, 0.998
#: Bits that may differ at similarity 0.8, of 256: 38.8 are expected (angle between the shingle sets), 5.7 are one deviation.
SIMILAR_RADIUS = 57
DIFFER_AT_SIMILAR = 0.1515
#: Sets and shingles of a family's block, about.
BLOCK_SETS, BLOCK_GRAMS = 2_048, 2_000_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words (the whole sequence if there are fewer), repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(found) - words + 1
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from each hash; k = 0 is the hash itself."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit words; a bit is set if it is in over half of the hashes."""
    out = np.zeros(lanes, dtype=np.uint64)
    for k in range(lanes):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 15):
            part = _mixed(hashes[at : at + (1 << 15)], k)
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int, lanes: int = 1) -> DataFrame:
    """doc_id and fp0, fp1 ... (signed 64-bit) of every row."""
    names = [f"fp{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = np.array([fingerprint(shingle_hashes(t, words), lanes) for t in part.column("text").to_pylist()]).view(np.int64).reshape(-1, lanes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(made[:, k]) for k in range(lanes))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).sum(axis=-1, dtype=np.int64)


class Forest:
    """Union-find over the points of one leaf."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        for r in {self.root(j) for j in others.tolist()}:
            a, b = sorted((self.root(i), r))
            self.up[b] = a


def link_leaf(points: np.ndarray, radius: int) -> np.ndarray:
    """The local root of each point: equal for two points exactly if a chain of pairs within the radius joins them."""
    forest = Forest(len(points))
    todo = [np.arange(len(points))]
    while todo:
        members = todo.pop()
        if len(members) > LOCAL_POINTS:
            d = distances(points[members], points[members[0]])
            mu = int(np.median(d))
            inner, outer = members[d <= mu], members[d > mu - radius]
            if max(len(inner), len(outer)) <= 0.8 * len(members):
                todo += [inner, outer]
                continue
        _link_balls(points, members, radius, forest)
    return np.array([forest.root(i) for i in range(len(points))])


def _link_balls(points: np.ndarray, members: np.ndarray, radius: int, forest: Forest) -> None:
    """Take off the ball of the first point, again and again. All of it links to its centre; what lies within two radii
    may link to the ball's points; beyond that the triangle bound excludes it."""
    while len(members) > 1:
        d = distances(points[members], points[members[0]])
        near = d <= radius
        ball, rest = members[near], members[~near]
        if len(ball) > 1:
            forest.join(ball[0], ball[1:])
            shell = members[(d > radius) & (d <= 2 * radius)]
            for i in shell.tolist():
                hit = ball[distances(points[ball], points[i]) <= radius]
                if len(hit):
                    forest.join(i, hit[:1])
        members = rest


def fit_tree(sample: np.ndarray, leaf: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, mu, inner child, outer child); a leaf is (0, 0, -1, its number)."""
    nodes: list[tuple[int, int, int, int] | None] = [None]
    todo, leaves = [(0, sample)], 0
    while todo:
        at, points = todo.pop()
        if len(points) > leaf:
            d = np.bitwise_count(points ^ points[0]).astype(np.int64)
            mu = int(np.median(d))
            inner, outer = points[d <= mu], points[d > mu]
            if len(outer) and mu >= radius:
                nodes[at] = (int(points[0]), mu, len(nodes), len(nodes) + 1)
                todo += [(len(nodes), inner), (len(nodes) + 1, outer)]
                nodes += [None, None]
                continue
        nodes[at] = (0, 0, -1, leaves)
        leaves += 1
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, index of the point) for every leaf where the point may have partners."""
    vantage, mu, inner, outer = (np.array(x, dtype=t) for x, t in zip(zip(*nodes), (np.uint64, np.int64, np.int64, np.int64)))
    index, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    leaves, found = [], []
    while len(index):
        ended = inner[node] < 0
        leaves.append(outer[node[ended]])
        found.append(index[ended])
        index, node = index[~ended], node[~ended]
        d = np.bitwise_count(points[index] ^ vantage[node]).astype(np.int64)
        go_in, go_out = d <= mu[node], d > mu[node] - radius
        index, node = np.concatenate([index[go_in], index[go_out]]), np.concatenate([inner[node[go_in]], outer[node[go_out]]])
    return np.concatenate(leaves), np.concatenate(found)


def _segments(batches: Iterator[pa.RecordBatch], key: str, names: list[str]) -> Iterator[np.ndarray]:
    """The rows of each run of equal keys, as a matrix of the columns ``names``; one run is held at a time."""
    held, last = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1) if len(keys) else np.empty((0, len(names)), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and keys[a] != last:
                yield np.concatenate(held)
                held = []
            held.append(rows[a:b])
            last = keys[a]
    if held:
        yield np.concatenate(held)


def chained(prints: np.ndarray, radius: int) -> np.ndarray:
    """As ``link_leaf``, for few wide fingerprints of which nearly all pairs lie beyond the radius: by their matrix."""
    n = len(prints)
    if n > LOCAL_POINTS:
        return link_leaf(prints, radius)
    far = np.zeros((n, n), dtype=np.uint16)
    for lane in prints.T:
        far += np.bitwise_count(lane[:, None] ^ lane[None, :])
    near, roots = far <= radius, np.arange(n)
    for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
        if roots[i] == i:
            group, size = near[i], 0
            while size < (size := int(group.sum())):
                group = near[group].any(axis=0)
            roots[group] = i
    return roots


def _links_in_runs(sharded: DataFrame, key: str, names: list[str], radius: int) -> DataFrame:
    """(a, b) for every run of equal keys: the first of ``names`` identifies a point, here of one and its local root.
    The others are its fingerprint; with one name it is both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for rows in _segments(batches, key, names):
            if len(rows) < 2:
                continue
            roots = chained(np.ascontiguousarray(rows[:, 1:]).view(np.uint64), radius) if len(names) > 1 else link_leaf(rows.view(np.uint64), radius)
            linked = np.flatnonzero(roots != np.arange(len(roots)))
            if len(linked):
                a.append(rows[linked, 0])
                b.append(rows[roots[linked], 0])
                held += len(linked)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return sharded.repartition(key).sortWithinPartitions(key).mapInArrow(run, "a long, b long")


def link_fingerprints(points: DataFrame, radius: int) -> DataFrame:
    """(node, root) of every fingerprint (column fp0, distinct) that links to another within ``radius`` bits."""
    n = points.count()
    sample = np.array([r[0] for r in points.orderBy(F.xxhash64("fp0"), "fp0").limit(SAMPLE_POINTS).collect()], dtype=np.int64).view(np.uint64)
    nodes = fit_tree(sample, max(8, len(sample) * LEAF_POINTS // max(n, 1)), radius)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp0").to_numpy(zero_copy_only=False)
            leaves, index = route(own.view(np.uint64), nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(own[index])], names=["leaf", "fp0"])

    return components(_links_in_runs(points.select("fp0").mapInArrow(shard, "leaf long, fp0 long"), "leaf", ["fp0"], radius))


def _group_of(points: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """(_key, component_id, _root): the smallest doc_id of the point's component, and a name of the component. ``points`` has key and _first, its own smallest."""
    rooted = points.join(linked, points[key] == linked["node"], "left").select(key, "_first", F.coalesce("root", key).alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return rooted.join(least, "_root").select(F.col(key).alias("_key"), "component_id", "_root")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp0 and component_id of every row: documents whose fingerprints link within ``radius`` bits."""
    folder = shared_folder(docs.sparkSession)
    marked = materialise(fingerprints(docs, words), "fingerprints", folder)
    points = materialise(marked.groupBy("fp0").agg(F.min("doc_id").alias("_first")), "points", folder)
    groups = _group_of(points, link_fingerprints(points, radius), "fp0")
    return marked.join(groups, F.col("fp0") == F.col("_key")).drop("_key", "_root")


def band_recall(bits: int, bands: int, radius: int = SIMILAR_RADIUS, differ: float = DIFFER_AT_SIMILAR) -> float:
    """The share of pairs that lie within ``radius`` bits and agree on one of ``bands`` random choices of ``bits`` bits, if
    each of 256 bits differs with probability ``differ``."""
    total = 0.0
    for d in range(radius + 1):
        alike = math.comb(256 - d, bits) / math.comb(256, bits)
        total += math.comb(256, d) * differ**d * (1 - differ) ** (256 - d) * (1 - (1 - alike) ** bands)
    return total


def choose_bands(points: int) -> np.ndarray:
    """The bits of every band: one row for each, as many as BAND_RECALL needs, as wide as so many points need."""
    bits = max(BAND_BITS, math.ceil(math.log2(max(points, 1) / BUCKET_POINTS)))
    bands = 8
    while band_recall(bits, bands, 256) < BAND_RECALL:
        bands += 4
    pick = np.random.default_rng(SEED)
    return np.stack([np.sort(pick.permutation(256)[:bits]) for _ in range(bands)])


def _shingle_sets(keyed: DataFrame, words: int) -> DataFrame:
    """_text_key and grams (the distinct shingle hashes) of every row of ``keyed`` (_text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_text_key"), pa.array(sets, pa.list_(pa.int64()))], names=["_text_key", "grams"])

    return keyed.mapInArrow(run, "_text_key long, grams array<long>")


def _set_fingerprints(keyed: DataFrame, words: int, names: list[str]) -> DataFrame:
    """doc_id, _text_key, point (a hash of the shingle set) and the fingerprint of the set of every row."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique(shingle_hashes(t, words)) for t in part.column("text").to_pylist()]
                made = np.array([fingerprint(s, len(names)) for s in sets]).view(np.int64).reshape(-1, len(names))
                point = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_text_key"), pa.array(point), *(pa.array(made[:, k]) for k in range(len(names)))], names=["doc_id", "_text_key", "point", *names])

    return keyed.mapInArrow(run, "doc_id long, _text_key long, point long, " + ", ".join(f"{n} long" for n in names))


def _banded(points: DataFrame, bands: np.ndarray, carried: list[str], names: list[str]) -> DataFrame:
    """band, ``carried`` and the fingerprint, once for each band."""
    weights = 1 << np.arange(bands.shape[1])

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in [*carried, *names]]
            bits = np.unpackbits(np.stack(columns[len(carried) :], axis=1).view(np.uint8).reshape(-1, 32), axis=1, bitorder="little")
            for k, chosen in enumerate(bands):
                key = bits[:, chosen].astype(np.int64) @ weights + (k << bands.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, columns)], names=["band", *carried, *names])

    return points.select(*carried, *names).mapInArrow(band, ", ".join(f"{n} long" for n in ["band", *carried, *names]))


def similar_sets(sets: list[np.ndarray], first: int) -> list[tuple[int, int]]:
    """Links that join whatever is similar (intersection over union at least 0.8): among all sets, or, with ``first``,
    between the first ones and the others."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[gram] > 1
    owner, gram = owner[shared], gram[shared]
    own = np.searchsorted(owner, np.arange(n + 1))
    order = np.argsort(gram, kind="stable")
    holders, start = owner[order], np.append(0, np.cumsum(np.bincount(gram, minlength=len(times))))
    forest, links = Forest(n), []
    for i in range(first or n):
        grams = gram[own[i] : own[i + 1]]
        count = start[grams + 1] - start[grams]
        at = np.repeat(start[grams] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(holders[at], minlength=n)
        similar = 5 * both >= 4 * (sizes[i] + sizes - both)
        similar[: max(first, i + 1)] = False
        for j in np.flatnonzero(similar).tolist():
            if forest.root(i) != forest.root(j):
                forest.join(i, np.array([j]))
                links.append((i, j))
    return links


def _similar_in_families(members: DataFrame) -> DataFrame:
    """(a, b): links between the similar sets of each family. ``members``: point, family, grams."""
    size = F.size("grams").cast("long")
    blocks = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(size) / BLOCK_GRAMS), F.lit(1)).cast("int").alias("blocks"))
    placed = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "point", "grams")

    def solve(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        first = sum(block == key[1] for block, _, _ in rows) if key[1] < key[2] else 0
        links = similar_sets([grams for _, _, grams in rows], first) if first < len(rows) and (first or key[1] == key[2]) else []
        return [(max(rows[i][1], rows[j][1]), min(rows[i][1], rows[j][1])) for i, j in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            numbers = zip(*(batch.column(c).to_pylist() for c in ("family", "lo", "hi", "block", "point")))
            for at, (family, lo, hi, block, point) in enumerate(numbers):
                if (family, lo, hi) != key:
                    if rows:
                        out += solve(key, rows)
                    key, rows = (family, lo, hi), []
                rows.append((block, point, batch.column("grams")[at].values.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out = []
        if rows:
            out = solve(key, rows)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    keys = ["family", "lo", "hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "block", "point").mapInArrow(run, "a long, b long")


def near_duplicate_groups(docs: DataFrame, words: int = 5, radius: int = SIMILAR_RADIUS) -> DataFrame:
    """doc_id, component_id (and _root, _text_key, names of the component and of the text): documents whose sets of
    ``words``-word shingles are 0.8 similar, and what such links join.

    Links are exact. A pair at 0.8 is in one family if its 256-bit fingerprints lie within ``radius`` bits and share a
    band (see ``band_recall``), or by others between them; more similar ones more surely.
    """
    spark, names = docs.sparkSession, ["fp0", "fp1", "fp2", "fp3"]
    folder = shared_folder(spark)
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_key"))
    marked = materialise(_set_fingerprints(keyed, words, names), "fingerprints", folder)
    points = materialise(marked.groupBy("point", *names).agg(F.min("doc_id").alias("_first"), F.min("_text_key").alias("_text_key")), "points", folder)
    bands = choose_bands(points.count())

    chains = components(_links_in_runs(_banded(points, bands, ["point"], names), "band", ["point", *names], radius))
    active = points.select("point", "_text_key").join(chains.select(F.col("node").alias("point"), F.col("root").alias("family")), "point")
    active = materialise(active, "active", folder)
    texts = keyed.select("_text_key", "text").join(active.select("_text_key"), "_text_key", "left_semi")
    members = _shingle_sets(texts, words).dropDuplicates(["_text_key"]).join(active, "_text_key").select("point", "family", "grams")
    links = _similar_in_families(materialise(members, "members", folder))
    return marked.select("doc_id", "_text_key", "point").join(_group_of(points, components(links), "point"), F.col("point") == F.col("_key")).select("doc_id", "component_id", "_root", "_text_key")


def keep_one_of_each(docs: DataFrame, words: int = 5, radius: int = SIMILAR_RADIUS) -> DataFrame:
    """``docs`` without near duplicates: of each group the document with the smallest doc_id stays. Rows that repeat a
    doc_id with its text are one document and stay or go together; with another text they are another document, and of
    two such in one group the one with the smaller hash stays. Rows with a null doc_id stay."""
    found = near_duplicate_groups(docs, words, radius).where("doc_id = component_id")
    kept = found.groupBy(F.col("doc_id").alias("_kept"), "_root").agg(F.min("_text_key").alias("_kept_text")).select("_kept", "_kept_text").distinct()
    named = docs.where("doc_id is not null")
    same = (named["doc_id"] == F.col("_kept")) & (F.xxhash64(F.coalesce(named["text"], F.lit(""))) == F.col("_kept_text"))
    return named.join(kept, same, "left_semi").unionByName(docs.where("doc_id is null"))


def simhash_query(docs: DataFrame) -> DataFrame:
    found = simhash_components(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")

"""Embedding near-dedup on hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one point with a count. Points are dealt out to shards by hash; each shard becomes a graph, written as
a table of nodes with their neighbours. Then every shard's points are looked up in every shard's graph, a pair of shards
to a task. A look-up descends the upper layers and searches the ground layer with a beam, for many queries in step.
Before a task's queries, an audit looks up vectors made to lie just inside the threshold of known nodes, and real
queries whose links a scan has found; the beam doubles until the audit's recall reaches AUDIT. A query whose beam holds
nothing but links may have more of them: it goes to a wider beam, and from the widest to a scan of the whole shard. What
the float32 search proposes is verified by its cosine in double precision.

Links are counted where they are found and never leave as pairs: a task returns for every point how many it links with
in the other shard, and a spanning forest of the links, at most one edge for each point. A point and its neighbour look
for each other, in two tasks; of both counts for a point and a shard the larger is taken, so that what one of them missed
still counts for both. The components of all forests are those of all links.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component, and rows with a null vec_id,
link with nothing (n_links 0, a component of their own, kept); vectors meet those of their own dimension; rows that
repeat a vec_id, or a vector, are vectors of their own that count each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.ann import usable
from assayline.llm.common import materialise, remove_folder, shared_folder
from assayline.llm.components import components

#: Neighbours of a node on the ground layer (twice this many) and above, and the beam of building.
NEIGHBOURS = 12
BUILD_BEAM = 48
BATCH = 512
#: First beam of a search, widest beam before a scan, recall that the audit asks for, and its queries.
BEAM, WIDEST = 32, 512
AUDIT, AUDITED = 0.99, 96
#: Points of a shard at most; below SHARDS full shards there are SHARDS smaller ones, of LEAST_SHARD points or more.
SHARD, SHARDS, LEAST_SHARD = 65_536, 8, 1_024
_NONE = np.float32(-np.inf)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Each row at length 1, in double precision; rows of any magnitude."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), nearest first, of the ``width`` nearest nodes that a best-first search of one layer finds
    for each query from its entry nodes; -1 where there are fewer."""
    n = len(queries)
    ids, score, done = np.full((n, width), -1, dtype=np.int32), np.full((n, width), _NONE), np.ones((n, width), dtype=bool)
    seen = np.zeros((n, len(links)), dtype=bool)

    def take(rows: np.ndarray, near: np.ndarray) -> None:
        row, column = np.nonzero((near >= 0) & ~seen[rows[:, None], near])
        if not len(row):
            return
        node = near[row, column]
        seen[rows[row], node] = True
        found = np.full(near.shape, _NONE)
        found[row, column] = np.einsum("ij,ij->i", queries[rows[row]], vectors[node])
        better = np.flatnonzero(found.max(axis=1) > score[rows].min(axis=1))
        rows = rows[better]
        every = np.concatenate([score[rows], found[better]], axis=1)
        best = np.argpartition(-every, width - 1, axis=1)[:, :width]
        score[rows] = np.take_along_axis(every, best, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near[better]], axis=1), best, axis=1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros((len(better), near.shape[1]), dtype=bool)], axis=1), best, axis=1)

    active = np.arange(n)
    take(active, entry)
    while len(active):
        waiting = np.where(done[active] | (score[active] == _NONE), _NONE, score[active])
        pick = waiting.argmax(axis=1)
        more = waiting[np.arange(len(active)), pick] > _NONE
        active, pick = active[more], pick[more]
        if len(active):
            done[active, pick] = True
            take(active, links[ids[active, pick]])
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score = np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)
    ids[score == _NONE] = -1
    return ids, score


def diverse(vectors: np.ndarray, ids: np.ndarray, score: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` neighbours of each row: candidates (nearest first) nearer to the row than to those chosen before, then
    the nearest of the rest."""
    own = vectors[ids]
    alike = own @ own.transpose(0, 2, 1)
    chosen, count = np.zeros(ids.shape, dtype=bool), np.zeros(len(ids), dtype=np.int64)
    for k in range(ids.shape[1]):
        new = (ids[:, k] >= 0) & (count < m) & (np.where(chosen, alike[:, k], _NONE).max(axis=1) < score[:, k])
        chosen[:, k] = new
        count += new
    order = np.argsort(np.where(ids < 0, 2, ~chosen), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(ids, order, axis=1)


class SmallWorld:
    """The graph of one shard. Nodes stand in order of falling level, so that a layer's nodes are the first ones."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.levels, self.links = vectors, levels, links

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray) -> SmallWorld:
        layers = int(levels[0]) + 1
        graph = cls(vectors, levels, [np.full((int((levels >= k).sum()), NEIGHBOURS * (1 if k else 2)), -1, dtype=np.int32) for k in range(layers)])
        at = 1
        while at < len(vectors):
            end = min(at + min(BATCH, at), at + int((levels[at:] == levels[at]).sum()))
            graph._insert(at, end, int(levels[at]))
            at = end
        return graph

    def _insert(self, a: int, b: int, level: int) -> None:
        queries = self.vectors[a:b]
        entry = self.descend(queries, level)
        peers = queries @ queries.T
        np.fill_diagonal(peers, _NONE)
        n_peers = min(b - a - 1, 2 * NEIGHBOURS)
        near = np.argpartition(-peers, n_peers - 1, axis=1)[:, :n_peers] if n_peers else np.empty((b - a, 0), dtype=np.int64)
        for layer in range(level, -1, -1):
            ids, score = beam(self.vectors, self.links[layer], queries, entry, BUILD_BEAM)
            entry = ids
            every = np.concatenate([score, np.take_along_axis(peers, near, axis=1)], axis=1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :BUILD_BEAM]
            every = np.take_along_axis(every, order, axis=1)
            both = np.take_along_axis(np.concatenate([ids, near.astype(np.int32) + a], axis=1), order, axis=1)
            both[every == _NONE] = -1
            chosen = diverse(self.vectors, both, every, NEIGHBOURS)
            self.links[layer][a:b, : chosen.shape[1]] = chosen
            row, column = np.nonzero(chosen >= 0)
            self._link_back(layer, chosen[row, column], (row + a).astype(np.int32))

    def _link_back(self, layer: int, target: np.ndarray, source: np.ndarray) -> None:
        links = self.links[layer]
        width = links.shape[1]
        while len(target):
            order = np.argsort(target, kind="stable")
            target, source = target[order], source[order]
            first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
            now = place < width
            nodes, row = np.unique(target[now], return_inverse=True)
            new = np.full((len(nodes), width), -1, dtype=np.int32)
            new[row, place[now]] = source[now]
            held = links[nodes]
            new[(new[:, :, None] == held[:, None, :]).any(axis=2)] = -1
            every = np.concatenate([held, new], axis=1)
            full = (every >= 0).sum(axis=1) > width
            packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable")[:, :width], axis=1)
            if full.any():
                some = every[full]
                score = np.where(some >= 0, np.einsum("id,ijd->ij", self.vectors[nodes[full]], self.vectors[some]), _NONE)
                order = np.argsort(-score, axis=1, kind="stable")
                packed[full] = diverse(self.vectors, np.take_along_axis(some, order, axis=1), np.take_along_axis(score, order, axis=1), width)
            links[nodes] = packed
            target, source = target[~now], source[~now]

    def descend(self, queries: np.ndarray, level: int = 0) -> np.ndarray:
        """The entry node of each query on layer ``level``, from the layers above it."""
        entry = np.zeros((len(queries), 1), dtype=np.int32)
        for layer in range(len(self.links) - 1, level, -1):
            entry = beam(self.vectors, self.links[layer], queries, entry, 1)[0]
        return entry

    def within(self, queries: np.ndarray, least: float, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query, nodes) for the nodes found at similarity ``least`` or more, for every query that has any."""
        step = max(32, (1 << 25) // len(self.vectors))
        for at in range(0, len(queries), step):
            rows = np.arange(at, min(at + step, len(queries)))
            size = width
            while len(rows) and size <= WIDEST and size < len(self.vectors):
                ids, score = beam(self.vectors, self.links[0], queries[rows], self.descend(queries[rows]), size)
                full = score[:, -1] >= least  # there may be more
                for k in np.flatnonzero(~full & (score[:, 0] >= least)).tolist():
                    yield int(rows[k]), ids[k, score[k] >= least]
                rows, size = rows[full], size * 4
            for k in range(0, len(rows), 256):
                for row, score in zip(rows[k : k + 256].tolist(), queries[rows[k : k + 256]] @ self.vectors.T):
                    found = np.flatnonzero(score >= least)
                    if len(found):
                        yield row, found

    def audited(self, queries: np.ndarray, least: float) -> int:
        """The beam at which the audit passes: of nodes at the threshold from made-up queries, and of all links of a
        sample of ``queries``, nearly all are found. More than WIDEST: scan."""
        random = np.random.default_rng(len(self.vectors))
        known = random.permutation(len(self.vectors))[:AUDITED]
        aside = random.standard_normal((len(known), self.vectors.shape[1])).astype(np.float32)
        aside -= (aside * self.vectors[known]).sum(axis=1, keepdims=True) * self.vectors[known]
        aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-12)
        inside = np.float32(least + (1 - least) / 50)
        made = inside * self.vectors[known] + np.sqrt(1 - inside * inside) * aside
        sample = np.concatenate([made, queries[random.permutation(len(queries))[:AUDITED]]]).astype(np.float32)
        wanted = [set(np.flatnonzero(row >= least).tolist()) for row in sample @ self.vectors.T]
        total, width = sum(map(len, wanted)), BEAM
        while width <= WIDEST:
            found = sum(len(wanted[q].intersection(nodes.tolist())) for q, nodes in self.within(sample, least, width))
            if found >= AUDIT * total:
                break
            width *= 2
        return width


def _levels(points: np.ndarray) -> np.ndarray:
    """The level of each point, from its number alone: one point in NEIGHBOURS reaches the next layer."""
    h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    share = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    return np.floor(-np.log(share) / np.log(NEIGHBOURS)).astype(np.int64)


class Forest:
    """A spanning forest of links between numbered nodes."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, nodes: np.ndarray) -> None:
        """All these nodes are one."""
        roots = self.root[nodes]
        low = roots.min()
        if (roots != low).any():
            self.root[np.isin(self.root, roots)] = low

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return at, self.root[at]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


NODES = "dim int, shard int, node int, point long, copies long, vector array<double>, level int, links array<int>"


def _graph_of(shard: pa.Table) -> pa.Table:
    """The nodes of a shard's graph."""
    points = shard["point"].to_numpy()
    levels = _levels(points)
    order = np.lexsort([points, -levels])
    levels, shard = levels[order], shard.take(pa.array(order))
    vectors = unit(_matrix(shard["vector"]))
    graph = SmallWorld.build(vectors.astype(np.float32), levels)
    links = [np.concatenate([layer[k] for layer in graph.links[: level + 1]]) for k, level in enumerate(levels.tolist())]
    cuts = np.append(0, np.cumsum([len(x) for x in links]))
    exact = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
    near = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(links), pa.int32()))
    return pa.table(
        [shard["dim"], shard["shard"], pa.array(np.arange(len(levels)), pa.int32()), shard["point"], shard["copies"], exact, pa.array(levels, pa.int32()), near],
        names=[c.split()[0] for c in NODES.split(", ")],
    )


def _loaded(nodes: pa.Table) -> tuple[SmallWorld, pa.Table, np.ndarray]:
    """(graph, its nodes in order, their vectors)."""
    nodes = nodes.sort_by("node")
    exact, levels = _matrix(nodes["vector"]), nodes["level"].to_numpy()
    near = nodes["links"].combine_chunks()
    flat, starts = near.values.to_numpy(), near.offsets.to_numpy()
    links, at = [], 0
    for layer in range(int(levels[0]) + 1):
        width = NEIGHBOURS * (1 if layer else 2)
        links.append(flat[starts[:-1][levels >= layer][:, None] + at + np.arange(width)])
        at += width
    return SmallWorld(exact.astype(np.float32), levels, links), nodes, exact


MET = "point long, block int, links long, other long"


def _links_between(least: float):
    """Function of (graph's nodes, points looked up): how many of the other shard's vectors each point links with, as
    seen from its own look-up (points looked up) or from theirs (nodes), and a forest of these links."""

    def run(key: tuple, nodes: pa.Table, asking: pa.Table) -> pa.Table:
        _, shard, block = (x.as_py() for x in key)
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        others = np.empty(0, dtype=np.int64)
        if nodes.num_rows and asking.num_rows:
            graph, nodes, exact = _loaded(nodes)
            points, asked = nodes["point"].to_numpy(), asking["point"].to_numpy()
            copies, asking_copies, wide = nodes["copies"].to_numpy(), asking["copies"].to_numpy(), _matrix(asking["vector"])
            every, place = np.unique(np.concatenate([points, asked]), return_inverse=True)
            forest, near = Forest(len(every)), wide.astype(np.float32)
            out, back = np.zeros(len(asked), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
            for q, ids in graph.within(near, least - 1e-5, graph.audited(near, least - 1e-5)):
                ids = ids[(exact[ids] @ wide[q] >= least) & (points[ids] != asked[q])]
                if len(ids):
                    out[q] = copies[ids].sum()
                    back[ids] += asking_copies[q]
                    forest.join(np.append(place[ids], place[len(points) + q]))
            one, other = forest.edges()
            rows = [(asked[out > 0], np.full((out > 0).sum(), shard), out[out > 0]), (points[back > 0], np.full((back > 0).sum(), block), back[back > 0])]
            rows.append((every[one], np.full(len(one), -1), np.zeros(len(one), dtype=np.int64)))
            others = every[other]
        columns = [np.concatenate(x) for x in zip(*rows)] or [np.empty(0, dtype=np.int64)] * 3
        other = pa.concat_arrays([pa.nulls(len(columns[0]) - len(others), pa.int64()), pa.array(others)])
        return pa.table([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), other], names=[c.split()[0] for c in MET.split(", ")])

    return run


def near_duplicates(vectors: DataFrame, least: float) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, vector)."""
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession)
    takes_part = F.col("vec_id").isNotNull() & usable(F.col("vector"))
    rows = vectors.withColumn("h", F.when(takes_part, F.xxhash64("vector")))
    grouped = rows.where("h is not null").groupBy("h", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    points = materialise(grouped.withColumn("point", F.monotonically_increasing_id()), "points", folder)
    n = points.count()
    n_shards = max(1, -(-n // SHARD), min(SHARDS, n // LEAST_SHARD))
    dealt = points.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("point"), F.lit(n_shards)).cast("int").alias("shard"), "point", "copies", "vector")
    graphs = materialise(dealt.groupBy("dim", "shard").applyInArrow(_graph_of, NODES), "graphs", folder)
    every = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))
    nodes = graphs.withColumn("block", every).groupBy("dim", "shard", "block")
    asking = graphs.select("dim", F.col("shard").alias("block"), "point", "copies", "vector").withColumn("shard", every).groupBy("dim", "shard", "block")
    met = materialise(nodes.cogroup(asking).applyInArrow(_links_between(least), MET), "met", folder)
    seen = met.where("other is null").groupBy("point", "block").agg(F.max("links").alias("links"))
    counts = seen.groupBy("point").agg(F.sum("links").alias("links"))
    roots = components(met.where("other is not null").select(F.col("point").alias("a"), F.col("other").alias("b")))
    joined = points.join(roots, F.col("point") == F.col("node"), "left").withColumn("root", F.coalesce("root", "point"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component"))
    settled = joined.join(smallest, "root").join(counts, "point", "left").select("h", "vector", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    settled = materialise(settled, "settled", folder)
    for name in ("graphs", "met", "points"):
        remove_folder(spark, f"{folder}/{name}")
    out = rows.join(settled, ["h", "vector"], "left").withColumn("component", F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def smallworld_query(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")), 0.9)


ORACLE = """
WITH RECURSIVE p AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.other = link.a
), component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN n USING (vec_id)
"""

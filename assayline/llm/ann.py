"""Approximate nearest neighbours by cross-polytope hashing, multiprobe tables and exact reranking.

Each table turns unit vectors by three rounds of random signs and fast Hadamard transforms; a vector's bucket is its
nearest signed axis. A query looks into the PROBES nearest axes of each of TABLES tables. Whatever a bucket holds is
compared exactly, by inner product of the original vectors in double precision, in blocks; each block returns its best
few, and these merge to the result. Fewer expected candidates than ENOUGH per table widen the probing, and queries that
still found fewer than asked for go through all buckets of one table, which is exact.

Equal vectors are one point, with its smallest k + 1 ids (more can't appear in a result), so copies of a vector cost
nothing. A bucket is split into as many blocks as keep one bounded even if it held every point, and queries visit each.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as queries or
candidates; vectors are compared with those of their own dimension; a repeated vec_id is one row; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import materialise, shared_folder

TABLES = 8
PROBES = 10
ENOUGH = 200
#: Points that a block holds at most: an eighth of a million vectors of 64 floats are 32 MB.
BLOCK_POINTS = 1 << 17
SEED = 20_240_601


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=64)
def _signs(size: int, table: int) -> np.ndarray:
    return np.random.default_rng([SEED, size, table]).choice(np.array([-1.0, 1.0]), size=(3, size))


def rotate(vectors: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation of each row, padded to a power of two; three rounds of signs and Hadamard transforms."""
    size = 1 << max(1, int(np.ceil(np.log2(max(2, vectors.shape[1])))))
    turned = np.zeros((len(vectors), size))
    turned[:, : vectors.shape[1]] = vectors
    for signs in _signs(size, table):
        turned *= signs
        half = 1
        while half < size:
            view = turned.reshape(len(vectors), -1, 2, half)
            turned = np.concatenate([view[:, :, :1] + view[:, :, 1:], view[:, :, :1] - view[:, :, 1:]], axis=2).reshape(len(vectors), size)
            half *= 2
        turned /= np.sqrt(size)
    return turned


def axes(turned: np.ndarray, probes: int) -> np.ndarray:
    """The signed axes nearest to each row, best first; axis j points up as j and down as j + size."""
    both = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each dimension among the vectors of a batch."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    out = []
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)]))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort([ids[places], -scores[places]])][:k]


def _search(points: DataFrame, k: int, tables: int, probes: int, n: int) -> DataFrame:
    """(query, point, score): the k best of every block that each query point visits. ``points``: point, vector, asks."""
    splits = 1 + n // BLOCK_POINTS
    kind = points.schema["vector"].dataType
    row = f"key long, query boolean, point long, vector {kind.simpleString()}"
    names = ["key", "query", "point", "vector"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asks = batch.column("point").to_numpy(zero_copy_only=False), batch.column("asks").to_numpy(zero_copy_only=False)
            for rows, matrix in _matrix(batch.column("vector")):
                unit = matrix.astype(float)
                unit /= np.abs(unit).max(axis=1, keepdims=True)
                for table in range(tables):
                    turned = rotate(unit, table)
                    found = axes(turned, min(probes, 2 * turned.shape[1]))
                    base = (matrix.shape[1] * 64 + table) << 40
                    split = (ids[rows] * 0x9E3779B1 >> 9) % splits
                    own = pa.array(base + found[:, 0] * splits + split)
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.zeros(len(rows), dtype=bool)), pa.array(ids[rows]), batch.column("vector").take(pa.array(rows))], names=names)
                    asking = np.flatnonzero(asks[rows])
                    for probe in range(found.shape[1] if len(asking) else 0):
                        for s in range(splits):
                            key = pa.array(base + found[asking, probe] * splits + s)
                            yield pa.RecordBatch.from_arrays([key, pa.array(np.ones(len(asking), dtype=bool)), pa.array(ids[rows[asking]]), batch.column("vector").take(pa.array(rows[asking]))], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, vectors, held = None, [], [], None
        for batch in batches:
            keys, query, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "query", "point"))
            lengths = np.diff(batch.column("vector").offsets.to_numpy())
            flat, starts = batch.column("vector").values.to_numpy(zero_copy_only=False), batch.column("vector").offsets.to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != last:
                    last, ids, vectors, held = keys[a], [], [], None
                block = flat[starts[a] : starts[b]].reshape(b - a, lengths[a]).astype(float)
                if not query[a]:  # a block's candidates come before its queries
                    ids.append(own[a:b])
                    vectors.append(block)
                    continue
                if not ids:
                    continue
                if held is None:
                    held = (np.concatenate(ids), np.concatenate(vectors))
                out: tuple[list, list, list] = ([], [], [])
                for at in range(0, b - a, 256):
                    scores = block[at : at + 256] @ held[1].T
                    for q, line in zip(own[a + at : a + at + 256].tolist(), scores):
                        top = _best(line, held[0], k)
                        out[0].append(np.full(len(top), q))
                        out[1].append(held[0][top])
                        out[2].append(line[top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query", "point", "score"])

    placed = points.select("point", "vector", "asks").mapInArrow(place, row)
    met = placed.repartition("key").sortWithinPartitions("key", "query").mapInArrow(compare, "query long, point long, score double")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    return met.groupBy("query", "point").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k).drop("place")


def nearest(vectors: DataFrame, asks: Column, k: int, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row of ``vectors`` (vec_id, embedding) that
    ``asks`` holds for, without the row itself."""
    folder = shared_folder(vectors.sparkSession)
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), asks.alias("asks"))
    in_order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.select("vec_id", "vector").distinct().withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= k + 1)
    listed = few.groupBy("vector").agg(F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    wanted = rows.groupBy("vector").agg(F.max("asks").alias("asks"))
    points = materialise(listed.join(wanted, "vector"), "points", folder)
    queries = rows.where("asks").select("vec_id", "vector").distinct().join(points.select("point", "vector"), "vector").select(F.col("vec_id").alias("query_id"), "point")
    n = points.count()
    found = materialise(_search(points, k + 1, tables, max(probes, -(-128 * ENOUGH // max(n, 1))), n), "found", folder)
    total = points.agg(F.sum(F.size("ids"))).first()[0] or 0
    counted = found.join(points.select("point", F.size("ids").alias("n_ids")), "point").groupBy("query").agg(F.sum("n_ids").alias("n"))
    starved = points.where("asks").join(counted.where(F.col("n") >= min(k + 1, total)), F.col("point") == F.col("query"), "left_anti").select(F.col("point").alias("hungry"))
    if starved.limit(1).count():
        again = points.join(starved.withColumn("again", F.lit(True)), F.col("point") == F.col("hungry"), "left").withColumn("asks", F.coalesce("again", F.lit(False)))
        more = _search(again, k + 1, 1, 1 << 20, n)
        found = found.join(starved, F.col("query") == F.col("hungry"), "left_anti").unionByName(more)
    each = found.join(points.select("point", F.explode("ids").alias("vec_id")), "point").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    lists = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return (
        queries.join(lists, F.col("point") == F.col("query"))
        .select("query_id", F.posexplode(others).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
    )


def ann_query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)

"""Hard-negative mining by blocked dense products.

Every component x becomes floor(256 x); a score is the inner product of these whole numbers. Anchors travel to the tasks
in blocks of BLOCK_COMPONENTS components, one block after another, and meet the candidates of a task in dense matrix
products in float64, which are exact as long as no product can reach 2^53 (else the block is multiplied in whole numbers
of any size). A first pass keeps the best positives of every anchor: each task holds k for an anchor, and these lists
merge. With the positives' scores known, a second pass keeps the best negatives within each positive's window, again k in
a task. Products are taken for a few rows first and then for more, so that the lists fill before large products are
searched for what still gets in.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; of rows
that repeat a vec_id the one with the smallest label, then vector, counts; vectors meet those of their own dimension; a
vector without components has the score 0 with its like; scores beyond 64 bits count as the largest number there is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import by_dimension, materialise, remove_folder, shared_folder

#: Components of the anchors that travel to the tasks at once, 16 MB.
BLOCK_COMPONENTS = 1 << 21
#: Numbers of a product.
PRODUCT = 1 << 21
#: Candidates of a task, where there are so many.
TASK_ROWS = 1 << 18
SCALE = 256
EXACT = 1 << 53
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of every component; numbers of any size where a double can't hold the product."""
    wide = vectors.astype(np.float64)
    if vectors.size and np.abs(wide).max() >= EXACT:
        return np.array([[int(x) * SCALE if abs(x) >= EXACT else math.floor(SCALE * x) for x in row] for row in wide.tolist()], dtype=object).reshape(wide.shape)
    return np.floor(wide * SCALE)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of two matrices of whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if int(abs(a).max()) * int(abs(b).max()) * a.shape[1] < EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    exact = [[int(x) for x in row] for row in a.tolist()], [[int(x) for x in row] for row in b.tolist()]
    return np.array([[min(max(sum(x * y for x, y in zip(p, q)), _LOW + 1), _HIGH) for q in exact[1]] for p in exact[0]], dtype=np.int64).reshape(len(a), len(b))


class Lists:
    """For each of ``n`` lists the k best (score, id): highest score, then smallest id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LOW)
        self.id = np.full((n, k), _HIGH)

    @property
    def least(self) -> np.ndarray:
        """What a score must reach to get in."""
        return self.score[:, -1]

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(lists)
        of, old, old_ids = np.repeat(touched, self.k), self.score[touched].ravel(), self.id[touched].ravel()
        held = old > _LOW
        of, score, ids = np.concatenate([of[held], lists]), np.concatenate([old[held], score]), np.concatenate([old_ids[held], ids])
        order = np.lexsort([ids, -score, of])
        of, score, ids = of[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        kept = place < self.k
        self.score[of[kept], place[kept]] = score[kept]
        self.id[of[kept], place[kept]] = ids[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of everything kept."""
        held = self.score > _LOW
        return np.repeat(np.arange(len(held)), held.sum(axis=1)), self.score[held], self.id[held]


class Anchors:
    """The anchors of a block by dimension; each knows its places among all of them."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.id = table["vec_id"].to_numpy()
        self.label = table["label"].to_numpy()
        self.parts = {m.shape[1]: (rows, whole(m)) for rows, m in by_dimension(table["vector"].combine_chunks())} if table.num_rows else {}


def _steps(n: int, width: int) -> Iterator[tuple[int, int]]:
    """Runs of rows: a few first, then ever more, until a product has PRODUCT numbers."""
    at, size = 0, 32
    while at < n:
        yield at, min(n, at + size)
        at += size
        size = max(1, min(2 * size, PRODUCT // max(1, width)))


def _positives(batch: pa.RecordBatch, anchors: Anchors, kept: Lists) -> None:
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    for rows, matrix in by_dimension(batch.column("vector")):
        own, block = anchors.parts.get(matrix.shape[1], (None, None))
        if own is None:
            continue
        matrix = whole(matrix)
        for label in np.intersect1d(labels[rows], anchors.label[own]).tolist():
            some, of = np.flatnonzero(labels[rows] == label), np.flatnonzero(anchors.label[own] == label)
            for a, b in _steps(len(some), len(of)):
                score = products(matrix[some[a:b]], block[of])
                enters = (score >= kept.least[own[of]]) & (ids[rows[some[a:b]]][:, None] != anchors.id[own[of]])
                row, column = np.nonzero(enters)
                if len(row):
                    kept.add(own[of[column]], score[row, column].astype(np.int64), ids[rows[some[a + row]]])


def _negatives(batch: pa.RecordBatch, anchors: Anchors, low: np.ndarray, high: np.ndarray, kept: Lists) -> None:
    """``low`` and ``high`` are the windows of each anchor's positives (anchor by place); list a * places + p is kept."""
    ids, labels, places = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), low.shape[1]
    for rows, matrix in by_dimension(batch.column("vector")):
        own, block = anchors.parts.get(matrix.shape[1], (None, None))
        if own is None:
            continue
        matrix = whole(matrix)
        for a, b in _steps(len(rows), len(own)):
            score = products(matrix[a:b], block)
            other = labels[rows[a:b]][:, None] != anchors.label[own]
            for place in range(places):
                least = np.maximum(low[own, place], kept.least[own * places + place])
                row, column = np.nonzero(other & (score >= least) & (score <= high[own, place]))
                if len(row):
                    kept.add(own[column] * places + place, score[row, column].astype(np.int64), ids[rows[a + row]])


def mine(vectors: DataFrame, anchors: Column, positives: int, negatives: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row of ``vectors`` (vec_id,
    label, vector) that ``anchors`` holds for and each of its best ``positives`` of the same label, the best ``negatives``
    of other labels whose score is from low[0]/low[1] to high[0]/high[1] of the positive's."""
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    n_tasks = spark.sparkContext.defaultParallelism + vectors.count() // TASK_ROWS
    one = rows.repartition(n_tasks, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own"))
    points = materialise(one.select("vec_id", "own.*"), "points", folder)
    asking = points.where(anchors)
    n_blocks = 1 + (asking.agg(F.sum(F.size("vector"))).first()[0] or 0) // BLOCK_COMPONENTS
    found = None
    for number in range(n_blocks):
        block = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == number).toArrow()
        best = materialise(_best_positives(points, block, positives), f"positives{number}", folder)
        part = materialise(_best_negatives(points, block, best, positives, negatives, low, high), f"negatives{number}", folder)
        found = part if found is None else found.unionByName(part)
    remove_folder(spark, f"{folder}/points")
    return found


def _best_positives(points: DataFrame, block: pa.Table, k: int) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(block)  # BLOCK_COMPONENTS numbers or so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(shared.value)
        kept = Lists(len(anchors.id), k)
        for batch in batches:
            _positives(batch, anchors, kept)
        of, score, ids = kept.rows()
        yield pa.RecordBatch.from_arrays([pa.array(anchors.id[of]), pa.array(ids), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])

    found = points.mapInArrow(run, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)


def _best_negatives(points: DataFrame, block: pa.Table, best: DataFrame, places: int, k: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast((block, best.toArrow()))  # the block's anchors, ``places`` rows each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, positives = shared.value
        anchors = Anchors(table)
        order = np.argsort(anchors.id)
        of = order[np.searchsorted(anchors.id[order], positives["anchor_id"].to_numpy())] if len(order) else order
        place, score, positive = positives["place"].to_numpy(), positives["positive_score"].to_pylist(), positives["positive_id"].to_numpy()
        least, most = np.full((len(anchors.id), places), _HIGH), np.full((len(anchors.id), places), _LOW)
        least[of, place] = [min(_HIGH, -(-low[0] * s // low[1])) for s in score]
        most[of, place] = [min(_HIGH, high[0] * s // high[1]) for s in score]
        kept = Lists(len(anchors.id) * places, k)
        for batch in batches:
            _negatives(batch, anchors, least, most, kept)
        of_list, negative_score, negative = kept.rows()
        which = np.zeros(len(anchors.id) * places, dtype=np.int64)
        which[of * places + place] = np.arange(len(of))
        row = which[of_list]
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors.id[of_list // places]), pa.array(positive[row]), pa.array(negative), positives["positive_score"].combine_chunks().take(pa.array(row)), pa.array(negative_score)],
            names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
        )

    found = points.mapInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def negatives_query(embeddings: DataFrame) -> DataFrame:
    label = F.col("label").cast("long")
    turned = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), turned.alias("label"), F.col("embedding").alias("vector"))
    return mine(vectors, F.col("vec_id") % 100 == 0, 5, 10, (30, 100), (90, 100))


ORACLE = """
WITH p AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM p a JOIN p b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair
  WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

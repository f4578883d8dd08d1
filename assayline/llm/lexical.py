"""Ranked lexical search by windowed bucket scoring.

Items (the queries) go out in blocks of BLOCK_TERMS terms. A first pass parts every whole text into terms and writes a
forward index of the block's terms: one row for each document, with the term numbers and how often each occurs. The same
tasks sum what the scores need of all documents: how many there are, their terms, and the documents of each term; a row
for each task, added up by Spark. A second pass sorts the forward index by doc_id within each partition and walks its
postings in fixed windows of WINDOW documents. Within a window a posting's contribution does not depend on the item, so
it is computed once; each item then adds up its postings in an array of WINDOW 64-bit counters, which stays in cache,
and marks what it touched in an occupancy bit set. Marked documents that reach the item's lowest kept score go into its
heap of k. Tasks return k rows for each item at most, and Spark merges them.

Defined cases: a null or empty text has no terms, and such a document counts nowhere; rows that repeat a doc_id are
documents of their own, and a null doc_id comes last among equal scores; rows that repeat an item_id (null is one of
them) are one item with the terms of all; an item without terms, or whose terms no document holds, gets no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import ascii_lower, materialise, remove_folder, shared_folder

#: Terms of items that travel to the tasks at once; a larger set of items takes more passes. One item is never split.
BLOCK_TERMS = 500_000
#: Documents of a window: their counters take 128 KB.
WINDOW = 1 << 14
CHUNK = 1 << 22
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8: A-Z lower-cased, other ASCII that is no letter or digit to a space.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in runs of about CHUNK bytes."""
    data = data.translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def forward_index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n, terms, tfs of every document that holds one of ``terms`` (numbered by their places); beside these one
    row for each task with its documents, their terms, and the documents of each number."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: k for k, term in enumerate(shared.value)}
        width, n_docs, n_terms = max(1, len(number)), 0, 0
        found_in = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sizes, owner, found = [], [], []
                for row, data in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    size = 0
                    for run_of in terms_of(data or b""):
                        size += len(run_of)
                        own = [number[t] for t in run_of if t in number]
                        found.append(np.array(own, dtype=np.int64))
                        owner.append(np.full(len(own), row, dtype=np.int64))
                    sizes.append(size)
                n = np.array(sizes, dtype=np.int64)
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
                if not found:
                    continue
                pair, tf = np.unique(np.concatenate(owner) * width + np.concatenate(found), return_counts=True)
                row, term = pair // width, pair % width
                found_in += np.bincount(term, minlength=width)
                rows, first = np.unique(row, return_index=True)
                cuts = pa.array(np.append(first, len(row)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows)), pa.array(n[rows]), pa.ListArray.from_arrays(cuts, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int64))), pa.nulls(len(rows), pa.int64()),
                    ],
                    names=["doc_id", "n", "terms", "tfs", "docs"],
                )
        held = np.flatnonzero(found_in)
        cuts = pa.array([0, len(held)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.array([n_terms]), pa.ListArray.from_arrays(cuts, pa.array(held.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(found_in[held])), pa.array([n_docs])],
            names=["doc_id", "n", "terms", "tfs", "docs"],
        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>, docs long")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def contributions(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Best:
    """The k best (score, doc_id) of an item: highest score, then smallest doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.doc, self.null = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort([doc, null, -score])[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.least = max(1, int(self.score[-1]))


def score_window(item_terms: list[np.ndarray], best: list[Best], doc: np.ndarray, null: np.ndarray, m: np.ndarray, slot: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray) -> None:
    """Score every item over one window: ``slot``, ``term``, ``tf`` are its postings."""
    by_term = np.argsort(term, kind="stable")
    slot, term = slot[by_term], term[by_term]
    adds = contributions(tf[by_term], m[slot], weights[term])
    first = np.searchsorted(term, np.arange(len(weights) + 1))
    sums, occupied = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=bool)
    starts = first.tolist()
    for terms, kept in zip(item_terms, best):
        for t in terms.tolist():
            a, b = starts[t], starts[t + 1]
            if a < b:  # a document stands once among the postings of a term
                sums[slot[a:b]] += adds[a:b]
                occupied[slot[a:b]] = True
        touched = np.flatnonzero(occupied)
        if len(touched):
            score = sums[touched]
            some = touched[score >= kept.least]
            if len(some):
                kept.add(sums[some], doc[some], null[some])
            sums[touched] = 0
            occupied[touched] = False


def _search(index: DataFrame, item_terms: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of every item (by its place in ``item_terms``)."""
    shared = index.sparkSession.sparkContext.broadcast((item_terms, weights))  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_terms, weights = shared.value
        best, held, size = [Best(k) for _ in item_terms], [], 0

        def settle() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            n = rows["n"].to_numpy()
            wide = int(n.max()) * n_docs * 50 >= 1 << 63
            share = np.array([50 * x * n_docs // n_terms for x in n.tolist()], dtype=np.int64) if wide else 50 * n * n_docs // n_terms
            lists, tfs = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks()
            slot = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            null = rows["doc_id"].is_null().to_numpy()
            doc = rows["doc_id"].fill_null(0).to_numpy()
            score_window(item_terms, best, doc, null, 50 + share, slot, lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(), weights)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, WINDOW - size)
                held.append(part)
                size += part.num_rows
                batch = batch.slice(part.num_rows)
                if size == WINDOW:
                    settle()
                    held, size = [], 0
        if size:
            settle()
        for item, kept in enumerate(best):
            if len(kept.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept.score), item)), pa.array(kept.doc, mask=kept.null), pa.array(kept.score)], names=["item", "doc_id", "score"])

    ordered = index.where("docs is null").select("doc_id", "n", "terms", "tfs").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of every item."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    wanted = items.select(F.col("item_id"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    wanted = materialise(wanted, "wanted", folder)
    n_blocks = 1 + wanted.count() // BLOCK_TERMS
    number = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    found = None
    for block in range(n_blocks):
        pairs = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id", "term").toArrow()
        ids, terms = pairs["item_id"].to_pylist(), [t.encode() for t in pairs["term"].to_pylist()]
        vocabulary = sorted(set(terms))
        place, of = {t: n for n, t in enumerate(vocabulary)}, {}
        for item_id, term in zip(ids, terms):
            of.setdefault(item_id, []).append(place[term])
        index = materialise(forward_index(docs, vocabulary), f"index{block}", folder)
        totals = index.where("docs is not null")
        n_docs, n_terms = (x or 0 for x in totals.agg(F.sum("docs"), F.sum("n")).first())
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for term, df in totals.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.tfs")).collect():  # the block's terms
            weights[term] = weight(n_docs, df)
        names = spark.createDataFrame(list(enumerate(of)), f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = _search(index, [np.array(t, dtype=np.int64) for t in of.values()], weights, n_docs, max(1, n_terms), k)
        ranked = best.join(F.broadcast(names), "item").withColumn("rank", number).where(F.col("rank") <= k)
        part = materialise(ranked.select("item_id", "rank", "doc_id", "score"), f"found{block}", folder)
        remove_folder(spark, f"{folder}/index{block}")
        found = part if found is None else found.unionByName(part)
    return found


def lexical_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return rank(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), 50)


ORACLE = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, total),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), total GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

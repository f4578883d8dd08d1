"""Line dedup: lines that several documents hold stay in the smallest document only.

Explode normalised lines, hash them, count the documents of each hash, drop lines at or over the threshold, put
the text together again by position. DataFrame functions only.

Defined cases: a null or empty text is one empty line. A row with a null doc_id is no document to count: it keeps all
its lines. Rows that repeat a doc_id count as one document, and each row is treated by its own text. Columns beside
doc_id and text go through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.values import let
from assayline.llm.common import WS, ascii_lower, materialise, remove_folder, shared_folder

MIN_CHARS = 10
MIN_DOCS = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without outer ASCII white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WS)))


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_doc, _text_hash, _positions): the line numbers that each text loses.

    A key travels as two 64-bit hashes with different seeds; lines are hashed once, into a narrow table. The count of
    documents per key combines on the map side: for a threshold of two, comparing the smallest and largest doc_id is
    enough; above that the distinct (key, doc) pairs are counted. The keys found are a table too, so that both sides of
    the join are plain reads: Spark broadcasts a small one, and else splits the partitions of frequent keys (adaptive
    skew join).
    """
    folder = shared_folder(docs.sparkSession)
    keyed = (
        docs.where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"), lines_of(F.col("text")).alias("_lines"))
        .select("_doc", "_text_hash", F.posexplode("_lines").alias("_pos", "_line"))
        .withColumn("_key", key_of(F.col("_line")))
        .where(F.length("_key") >= min_chars)
        .select("_doc", "_text_hash", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )
    keyed = materialise(keyed, "lines", folder)
    if min_docs == 2:
        repeated = keyed.groupBy("_h1", "_h2").agg(F.min("_doc").alias("_keeper"), F.max("_doc").alias("_last")).where("_keeper < _last")
    else:
        repeated = (
            keyed.groupBy("_h1", "_h2", "_doc").agg(F.lit(1).alias("_one"))
            .groupBy("_h1", "_h2").agg(F.min("_doc").alias("_keeper"), F.count("*").alias("_docs"))
            .where(F.col("_docs") >= min_docs)
        )
    repeated = materialise(repeated.select("_h1", "_h2", "_keeper"), "repeated", folder)
    dropped = keyed.join(repeated, ["_h1", "_h2"]).where("_doc > _keeper").groupBy("_doc", "_text_hash")
    positions = materialise(dropped.agg(F.collect_set("_pos").alias("_positions")), "positions", folder)
    for name in ("lines", "repeated"):
        remove_folder(docs.sparkSession, f"{folder}/{name}")
    return positions


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` put together from the lines kept, plus n_lines and n_dropped (in place of columns so named)."""
    drops = dropped_positions(docs.select("doc_id", "text"), min_chars, min_docs).select(F.struct("*").alias("_drop"))
    row = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row_hash"))
    lines, positions = lines_of(F.col("_row.text")), F.col("_drop._positions")

    def kept(split: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), positions)
        return F.array_join(F.transform(places, lambda i: F.get(split, i)), "\n")

    text = F.when(positions.isNull(), F.coalesce("_row.text", F.lit(""))).otherwise(let(lines, kept))
    made = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(positions), F.lit(0)).cast("long"), "text": text}
    rest = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in made]
    joined = row.join(drops, (F.col("_row.doc_id") == F.col("_drop._doc")) & (F.col("_row_hash") == F.col("_drop._text_hash")), "left")
    return joined.select(*rest, *(c.alias(name) for name, c in made.items()))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, repeated lines gone, and n_chars (where there is one) counted again."""
    held = [F.col(c).alias(f"kept_{c}") for c in docs.columns if c not in ("doc_id", "text")]
    done = dedup_lines(docs.select("doc_id", "text", *held))
    columns = {c: F.col(c if c in ("doc_id", "text") else f"kept_{c}").alias(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*columns.values())


def line_dedup_query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.doc_id > r.keeper) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE r.keeper IS NULL OR k.doc_id <= r.keeper), '')) AS kept_sha256
FROM k LEFT JOIN r ON r.key = k.key GROUP BY k.doc_id
"""

"""Comparing tables: manifest differences, exact set equality, multiset matching, key unions, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest_diff(expected: DataFrame, actual: DataFrame, limit: int | None = 20) -> DataFrame:
    """path and problem of files that are missing or differ, sorted, the first ``limit``."""
    joined = expected.join(actual.select("path", F.col("hash").alias("_other")), "path", "left").where(~F.equal_null("hash", "_other"))
    out = joined.select("path", F.when(F.col("_other").isNull(), "missing").otherwise("different").alias("problem")).orderBy("path")
    return out if limit is None else out.limit(limit)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a and only_b: rows (with multiplicity) of one side that the other lacks; equal sets have 0 and 0."""
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))


def multiset_match(expected: DataFrame, actual: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each expected row takes one actual row of its key; counts of matched, missing and unexpected rows for each key."""
    numbered = [f.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).select(*keys, "_n", F.lit(1).alias(side)) for f, side in ((expected, "_e"), (actual, "_a"))]
    joined = numbered[0].join(numbered[1], [*keys, "_n"], "full")
    return joined.groupBy(*keys).agg(
        F.count_if(F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("matched"), F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected")
    )


def key_union(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys of either side with both values and whether they differ."""
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full").withColumn("differs", ~F.equal_null("a", "b"))


def accuracy(frame: DataFrame) -> DataFrame:
    """Totals of expected, mapped and correct, in percent, against the thresholds 98 and 100."""
    sums = frame.agg(F.sum("expected").alias("expected"), F.sum("mapped").alias("mapped"), F.sum("correct").alias("correct"))
    mapped, correct = F.round(100.0 * F.col("mapped") / F.col("expected"), 4), F.round(100.0 * F.col("correct") / F.col("mapped"), 4)
    return sums.select("*", mapped.alias("mapped_pct"), correct.alias("correct_pct"), ((mapped >= 98) & (correct >= 100)).alias("passed"))

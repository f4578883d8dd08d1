"""Review state: reasons, decisions, readiness, row and file numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.session import shared_folder


def first_reason(*reasons: tuple[Column, str]) -> Column:
    """The first that applies, in the order given."""
    return F.coalesce(*(F.when(condition, F.lit(text)) for condition, text in reasons))


def decision(blocked: Column, confidence: Column, override: Column) -> Column:
    """Blocked rows are excluded and locked; sure ones are included, others pending, unless the reviewer decided."""
    return F.when(blocked, "excluded").otherwise(F.coalesce(override, F.when(confidence == "high", "included").otherwise("pending")))


def with_numbers(frame: DataFrame, order: list[str], name: str, prefix: str, within: list[str] | None = None) -> DataFrame:
    """Sequential ids (prefix1, prefix2, ...) in ``order``, over everything or within keys. Rows that ``order`` does not tell
    apart are numbered in any order."""
    if within:
        return frame.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*within).orderBy(*order))))
    # ranges of rows, sorted and counted apart; the table is written once, so that its ranges stay what they were
    spark = frame.sparkSession
    ranges = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    path = shared_folder(spark)
    ranges.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).write.parquet(path)
    placed = spark.read.parquet(path)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = placed.join(F.broadcast(starts), "_part")  # one row of two numbers for each range
    return numbered.withColumn(name, F.concat(F.lit(prefix), (F.col("_start") + F.col("_at") + 1).cast("string"))).drop("_part", "_at", "_start")


def confirmed(rows: DataFrame, draw: list[str], order: list[str]) -> DataFrame:
    """``rows`` (code, decision and others) once a reviewer has confirmed all that was pending, in ``order``, and kept one of
    each test of a draw: a pending row is excluded if its test is included already. Rows without a code are no duplicates."""
    same_test = Window.partitionBy(*draw, "code")
    pending = F.col("decision") == "pending"
    taken = F.max(F.col("decision") == "included").over(same_test)
    earlier = F.sum(pending.cast("int")).over(same_test.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    again = F.col("code").isNotNull() & (taken | (F.coalesce(earlier, F.lit(0)) > 0))
    return rows.withColumn("decision", F.when(pending, F.when(again, "excluded").otherwise("included")).otherwise(F.col("decision")))


def check_reason(issues: Column, confidence: Column) -> Column:
    """What a reviewer is told about a row to check, the first that applies."""
    told = first_reason(
        (F.array_contains(issues, "duplicate"), "This test appears more than once for this date. Keep one and leave the other out."),
        (F.array_contains(issues, "ocr"), "Read from a scan. Compare it with your report."),
        (confidence == "medium", "We're less sure about this match. Compare it with your report."),
    )
    return F.coalesce(told, F.lit("Compare this with your report."))


def repeat_to(rows: DataFrame, keys: list[str], order: list[str], n: Column, name: str) -> DataFrame:
    """The rows of each key over and over, in ``order``, until there are ``n`` of them; ``name`` counts them from 0."""
    own = Window.partitionBy(*keys)
    counted = rows.withColumns({"_p": F.row_number().over(own.orderBy(*order)) - 1, "_m": F.count("*").over(own).cast("int")})
    return counted.withColumn(name, F.explode(F.when(F.col("_p") < n, F.sequence("_p", n - 1, F.col("_m"))))).drop("_p", "_m")


def readiness(problems: list[tuple[Column, str]]) -> Column:
    """All problems that hold, in order."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(text)) for condition, text in problems)))


def value_text(comparator: Column, value: Column, unit: Column) -> Column:
    return F.concat_ws(" ", F.nullif(comparator, F.lit("")), value, F.nullif(unit, F.lit("")))


def range_text(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit("–"), high)).when(high.isNotNull(), F.concat(F.lit("≤ "), high)).when(low.isNotNull(), F.concat(F.lit("≥ "), low))

"""Numbers of rows, decisions of a reviewer, and rows repeated to a size."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from assayline.operators import review


def test_numbers_over_everything(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, *range(50)]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "a int, b int").repartition(7)
    found = {r["b"]: r["id"] for r in review.with_numbers(frame, ["a", "b"], "id", "x").collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert found == {b: f"x{i}" for i, (_, b) in enumerate(ordered, 1)}
    assert review.with_numbers(frame.limit(0), ["a", "b"], "id", "x").count() == 0
    same = spark.createDataFrame([(1, 1)] * 40, "a int, b int")
    assert {r["id"] for r in review.with_numbers(same, ["a"], "id", "x").collect()} == {f"x{i}" for i in range(1, 41)}


def test_one_of_each_test_is_confirmed(spark):
    rows = [
        ("d", 1, "A", "pending"), ("d", 2, "A", "included"), ("d", 3, "B", "pending"), ("d", 4, "B", "pending"), ("d", 5, "B", "excluded"), ("d", 6, None, "pending"), ("d", 7, None, "pending"),
        (None, 1, "B", "pending"), (None, 2, "B", "pending"), ("e", 1, "C", "excluded"),
    ]
    found = review.confirmed(spark.createDataFrame(rows, "draw string, n int, code string, decision string"), ["draw"], ["n"])
    assert {(r["draw"], r["n"]): r["decision"] for r in found.collect()} == {
        ("d", 1): "excluded", ("d", 2): "included", ("d", 3): "included", ("d", 4): "excluded", ("d", 5): "excluded", ("d", 6): "included", ("d", 7): "included",
        (None, 1): "included", (None, 2): "excluded", ("e", 1): "excluded",
    }


def test_reasons_in_order(spark):
    rows = [(["ocr", "duplicate"], "low"), (["ocr"], "medium"), ([], "medium"), ([], "low"), (None, None)]
    told = [r[0] for r in spark.createDataFrame(rows, "i array<string>, c string").select(review.check_reason(F.col("i"), F.col("c"))).collect()]
    assert [t.split(" ")[0] for t in told] == ["This", "Read", "We're", "Compare", "Compare"]


def test_rows_repeated_to_a_size(spark):
    rows = spark.createDataFrame([(k, p) for k in (1, 2, None) for p in range(3)], "k int, p int")
    found = review.repeat_to(rows, ["k"], ["p"], F.when(F.col("k") == 1, 7).when(F.col("k") == 2, 2).otherwise(0), "i")
    assert sorted(tuple(r) for r in found.select("k", "i", "p").collect()) == [(1, i, i % 3) for i in range(7)] + [(2, 0, 0), (2, 1, 1)]

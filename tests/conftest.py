"""One local session for all tests, and small helpers."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from assayline.session import local_session

    session = local_session(4, "tests", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """A column expression over a list of strings."""
    from pyspark.sql import functions as F

    def run(expression, inputs, schema="i int, s string"):
        rows = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], schema).select("i", expression(F.col("s")).alias("out")).orderBy("i").collect()
        return [r["out"] for r in rows]

    return run

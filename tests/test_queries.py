"""Every query with SQL gives DuckDB's rows; every other one runs."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from assayline.plans import catalogue
from tests.comparing import frame_rows, oracle_rows

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, name):
    frame = catalogue.QUERIES[name](spark, ROOT)
    columns = sorted(frame.columns)
    assert frame_rows(frame, columns) == oracle_rows(catalogue.ORACLES[name], ROOT, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    rows = catalogue.QUERIES[name](spark, ROOT).collect()
    assert rows and all(r["same"] for r in rows if "same" in r)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_only_what_they_need(spark):
    plan = catalogue.QUERIES["q00_flagship"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and not any("l_tax" in line or "o_totalprice" in line for line in schemas)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan

"""Rows of a Spark frame against rows of DuckDB over the same parquet files."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


def oracle_rows(sql: str, root: str, columns: list[str]) -> Counter:
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    names = ", ".join(f'"{c}"' for c in columns)
    return Counter(repr(tuple(map(plain, r))) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall())


def frame_rows(frame, columns: list[str]) -> Counter:
    return Counter(repr(tuple(map(plain, r))) for r in frame.select(*columns).collect())

"""What the corpus operators share: table access, intermediate tables in the shared folder, batches as Python values.

Defined cases: a null text is an empty one in ``text_blocks``; a table without rows is written and read back with its
columns; ``by_dimension`` takes batches without rows, but no null vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.session import shared_folder

__all__ = ["LOWER", "UPPER", "WS", "ascii_lower", "by_dimension", "materialise", "remove_folder", "shared_folder", "table", "text_blocks"]

#: ASCII white space, [\x20\x09-\x0D].
WS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def materialise(frame: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = frame.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}"
    frame.write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_blocks(column: pa.Array, chars: int) -> Iterator[list[str]]:
    """Runs of the texts of a column (null: empty) of about ``chars`` characters together, a few rows at a time in Python."""
    block, size = [], 0
    for at in range(0, len(column), 64):
        for text in column.slice(at, 64).to_pylist():
            block.append(text or "")
            size += len(block[-1])
            if size >= chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def by_dimension(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each dimension among the vectors of a batch; none of them is null or holds a null."""
    starts = column.offsets.to_numpy()
    lengths = np.diff(starts)
    flat, out = column.values.to_numpy(zero_copy_only=False), []
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out.append((rows, flat[starts[:-1][rows][:, None] + np.arange(d)]))
    return out

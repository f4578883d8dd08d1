"""Session helpers shared by tests, the benchmark and the query catalogue."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "assayline", **extra: str) -> SparkSession:
    """A local session with the settings the test suite and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ASSAYLINE_DRIVER_MEMORY", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    A local session that names none gets a folder of this machine; any other has to name one.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    root = root or (current.get() if current.isDefined() else None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="assayline-")
    return f"{root.rstrip('/')}/assayline-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` would, once for each context. Where they can import it
    already (same folder, PYTHONPATH) this changes nothing."""
    context = spark.sparkContext
    if getattr(context, "_assayline_shipped", False):
        return
    home = Path(__file__).resolve().parent
    if home.is_dir():
        packed = Path(tempfile.mkdtemp(prefix="assayline-")) / "assayline.zip"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(home.rglob("*.py")):
                archive.write(file, Path(home.name) / file.relative_to(home))
        context.addPyFile(str(packed))
    context._assayline_shipped = True

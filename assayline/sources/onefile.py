"""Folders of files as tables: a sink of one file for each row, ``frame.write.format("one_file_each").save(folder)``, and
every file below a folder as a row, ``spark.read.format("one_file_each").load(folder)``.

Reading gives path ("/" and the path from the folder on) and content. Spark's own readers leave out files whose names
begin with a dot or an underscore; this one has them all, but for what a running job has not yet put in place. Files are
listed once, in the driver, and dealt out by size.

The frame has name (a file's name in the folder) and content (string or binary). A task writes into a folder of its own
attempt; when all tasks are through, the job moves the files of the attempts that count into place, and a lost or repeated
attempt counts for nothing. Mode ``append`` adds to a folder and replaces files of the same name; ``overwrite`` deletes
the files that were there and are not written again. Only the paths of attempts come to the driver as messages.

Defined cases: a null content is an empty file; a null or empty name, one with a slash, a leading dot or underscore, or
one that two rows have, fails the job before any file is in place; no rows make an empty folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from assayline.functions import codec
from assayline.operators import card

FORMAT = "one_file_each"
#: Files that are moved at a time, and how many a thread takes at once.
MOVERS, RUN = 16, 500
#: Bytes and files that one task reads at least, where there are that many.
SHARE, MOST = 64 << 20, 10_000
JOB = "_job-"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the folder in it that a path or URL means."""
    store, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, folder.rstrip("/")


@dataclass
class Share(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class OneFileEach(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return OneFileReader(self.options["path"], self.options.get("suffix", ""), self.options.get("deep", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        made = OneFileWriter(self.options["path"], schema, overwrite)
        store, folder = open_folder(made.path)
        store.create_dir(f"{folder}/{made.job}", recursive=True)
        return made


def _runs(names: pa.Array, of: int) -> list[pa.Array]:
    """Runs of names for a thread to take one after the other, short enough that of so many names each thread has its share."""
    size = min(RUN, -(-of // MOVERS))
    return [names.slice(at, size) for at in range(0, len(names), size)] if size else []


class OneFileReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, deep: bool) -> None:
        self.path, self.suffix, self.deep = path, suffix, deep

    def partitions(self) -> list[InputPartition]:
        store, folder = open_folder(self.path)
        shares, size = [Share([])], 0
        for info in store.get_file_info(fs.FileSelector(folder, recursive=self.deep)):
            inside = info.path[len(folder) :]
            if not info.is_file or inside.startswith(f"/{JOB}") or not inside.endswith(self.suffix):
                continue
            if size >= SHARE or len(shares[-1].paths) >= MOST:
                shares.append(Share([]))
                size = 0
            shares[-1].paths.append(inside)
            size += info.size
        return shares

    def read(self, partition: Share) -> Iterator[tuple[str, bytes]]:
        store, folder = open_folder(self.path)
        for path in partition.paths:
            with store.open_input_stream(f"{folder}{path}") as source:
                yield path, source.read()


class OneFileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        lacking = {"name", "content"} - set(schema.names)
        if lacking:
            raise ValueError(f"the sink needs the columns name and content, {sorted(lacking)} not found")
        self.path, self.overwrite, self.job = path, overwrite, f"{JOB}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Attempt:
        store, folder = open_folder(self.path)
        task = TaskContext.get()
        mine = f"{folder}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(mine, recursive=False)  # a failed job's folder is gone
        seen = set()
        for row in iterator:
            name, content = row["name"], row["content"]
            if not name or "/" in name or name[0] in "._" or name in seen:
                raise ValueError(f"not a name of a file, or a name that comes twice: {name!r}")
            seen.add(name)
            with store.open_output_stream(f"{mine}/{name}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Attempt(mine)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, folder = open_folder(self.path)
        attempts = [m.folder for m in messages if m]
        written = [pa.array([f.base_name for f in store.get_file_info(fs.FileSelector(a))], pa.large_string()) for a in attempts]
        names = pa.chunked_array(written, pa.large_string())
        if pc.count_distinct(names).as_py() < len(names):
            self.abort(messages)
            raise ValueError("a name of a file comes twice")

        def move(at: str, some: pa.Array) -> None:
            for name in some.to_pylist():
                store.move(f"{at}/{name}", f"{folder}/{name}")

        def delete(some: pa.Array) -> None:
            for name in some.to_pylist():
                store.delete_file(f"{folder}/{name}")

        with ThreadPoolExecutor(MOVERS) as pool:
            if self.overwrite:
                there = pa.array([f.base_name for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file], pa.large_string())
                list(pool.map(delete, _runs(there.filter(pc.invert(pc.is_in(there, names.combine_chunks()))), len(there))))
            list(pool.map(lambda m: move(*m), [(a, run) for a, own in zip(attempts, written, strict=True) for run in _runs(own, len(names))]))
        self._clean(store, folder)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, folder = open_folder(self.path)
        self._clean(store, folder)

    def _clean(self, store: fs.FileSystem, folder: str) -> None:
        at = f"{folder}/{self.job}"
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


def write_files(files: DataFrame, folder: str, mode: str = "append") -> None:
    """One file in ``folder`` for each row of ``files`` (name, content)."""
    spark = files.sparkSession
    spark.dataSource.register(OneFileEach)
    # a file costs the same however small it is, so that rows must not be put together by their bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    files.select("name", "content").repartition(tasks, "name").write.format(FORMAT).mode(mode).save(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of every file below a folder."""
    spark.dataSource.register(OneFileEach)
    return spark.read.format(FORMAT).load(folder)


def read_texts(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """name, content of the text files of a folder, not of those below it; names with a leading dot or underscore are left
    out. Many small files make one task, which Spark's own reader would deal out a few at a time."""
    spark.dataSource.register(OneFileEach)
    found = spark.read.format(FORMAT).options(suffix=suffix, deep="false").load(folder).withColumn("name", F.substring("path", 2, 1 << 30))
    return found.where(~F.substring("name", 1, 1).isin(".", "_")).select("name", F.col("content").cast("string").alias("content"))


def card_files(cards: DataFrame, prefix: str, within: list[str], date: str, order: list[str], token: Column) -> DataFrame:
    """``within``, name and content of a file for each card; cards of one date of the same ``within`` are numbered."""
    nth = F.row_number().over(Window.partitionBy(*within, F.to_date(date)).orderBy(*order))
    content = card.json_object(("verifiableCredential", F.concat(F.lit("["), card.json_string(token), F.lit("]"))))
    name = F.concat(codec.file_name(prefix, F.col(date), F.col("_nth")), F.lit(".smart-health-card"))
    return cards.withColumn("_nth", nth).select(*within, name.alias("name"), content.alias("content"))

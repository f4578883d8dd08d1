"""Request limits: counts in tumbling windows, and a limiter with a state for each key.

The limiter lets a request pass if fewer than ``limit`` requests of its key have passed in the ``seconds`` before it; a
request that is refused does not count. Requests of a key are decided in the order of their times, equal ones by id. A
key's state is the times that passed last, ``limit`` of them at most.

On a stream, requests wait until the watermark has passed them, so that the order in which they arrive within the
lateness allowed changes nothing; one that is later than that is dropped by Spark and counted in its metrics. A key's
timer fires when its oldest waiting request can be decided, and last when nothing that passed counts any more: then its
state is gone.

Defined cases: a null key is a key; requests without a time take no part; a limit of zero refuses all.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000


def requests_per_window(requests: DataFrame, key: str, at: str, seconds: int = 60, limit: int = 10, late: str | None = None) -> DataFrame:
    """key, window start, n and whether n is over the limit. ``late`` sets the watermark of a streaming input."""
    if late:
        requests = requests.withWatermark(at, late)
    counted = requests.groupBy(F.col(key), F.window(at, f"{seconds} seconds").alias("_w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("_w.start").alias("window_start"), "n", (F.col("n") > limit).alias("limited"))


def passes(passed: deque, at: int, limit: int, span: int) -> bool:
    """Whether a request at this time passes, after those that ``passed``; times past their span leave."""
    while passed and passed[0] <= at - span:
        passed.popleft()
    if len(passed) >= limit:
        return False
    passed.append(at)
    return True


def _micros(frame: DataFrame, at: str) -> Column:
    """A time in microseconds; one without a zone is its own, whatever the session's zone."""
    if frame.schema[at].dataType.typeName() == "timestamp_ntz":
        since = F.col(at) - F.lit("1970-01-01").cast("timestamp_ntz")
        return (since.cast("interval second").cast("decimal(18,6)") * MICROS).cast("long")
    return F.unix_micros(F.col(at).cast("timestamp"))


def limited(requests: DataFrame, key: str, request: str, at: str, seconds: int = 60, limit: int = 10) -> DataFrame:
    """key, request, at and ``passed`` for a table of requests: one pass over rows sorted by key and time. A key of any size
    is a stream of rows in its task."""
    span = seconds * MICROS
    rows = requests.where(F.col(at).isNotNull()).select(F.col(key).cast("string").alias("_key"), F.col(key), F.col(request), F.col(at), _micros(requests, at).alias("_at"))
    schema = rows.select(key, request, at).withColumn("passed", F.lit(True)).schema

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Any = object()
        passed: deque = deque()
        for batch in batches:
            out = np.empty(batch.num_rows, dtype=bool)
            for i, (name, when) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("_at").to_numpy(zero_copy_only=False).tolist())):
                if name != last:
                    last, passed = name, deque()
                out[i] = passes(passed, when, limit, span)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, request, at)), pa.array(out)], names=[key, request, at, "passed"])

    return rows.repartition("_key").sortWithinPartitions("_key", "_at", request).mapInArrow(decide, schema)


class Limiter(StatefulProcessor):
    """Waiting requests and the times that passed last, for one key."""

    def __init__(self, seconds: int, limit: int) -> None:
        self.span, self.limit = seconds * MICROS, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, request long", "n int")
        self.passed = handle.getListState("passed", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, request in zip(frame["micros"].tolist(), frame["request"].tolist()):
                n = self.waiting.getValue((at, request))[0] if self.waiting.containsKey((at, request)) else 0
                self.waiting.updateValue((at, request), (n + 1,))
        self._wake(min((at for at, _ in self.waiting.keys()), default=None))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted(w for w in self.waiting.keys() if w[0] <= now)
        passed, out = deque(at for (at,) in self.passed.get()), []
        for at, request in ready:
            for _ in range(self.waiting.getValue((at, request))[0]):
                out.append((key[0], request, at, passes(passed, at, self.limit, self.span)))
            self.waiting.removeKey((at, request))
        while passed and passed[0] <= now - self.span:
            passed.popleft()
        self.passed.clear()
        if passed:
            self.passed.put([(at,) for at in passed])
        waits = min((at for at, _ in self.waiting.keys()), default=None)
        self._wake(passed[-1] + self.span if waits is None and passed else waits)
        if out:
            yield pd.DataFrame(out, columns=["key", "request", "micros", "passed"])

    def _wake(self, micros: int | None) -> None:
        """One timer a key, at the first millisecond that is not before this time."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if micros is not None:
            self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, key: str, request: str, at: str, late: str, seconds: int = 60, limit: int = 10) -> DataFrame:
    """key, request (long), at and ``passed`` of a stream, each request once the watermark has passed it. ``late``: how late
    a request may arrive. The session needs the RocksDB state store."""
    kinds = {c: requests.schema[c].dataType for c in (key, at)}
    timed = requests.where(F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(request).cast("long").alias("request"), _micros(requests, at).alias("micros"))
    keyed = timed.withColumn("time", F.timestamp_micros("micros")).withWatermark("time", late).groupBy("key")
    decided = keyed.transformWithStateInPandas(Limiter(seconds, limit), "key string, request long, micros long, passed boolean", "Append", "EventTime")
    since = F.make_dt_interval(secs=(F.col("micros") / MICROS).cast("decimal(18,6)"))
    when = F.lit("1970-01-01").cast("timestamp_ntz") + since if kinds[at].typeName() == "timestamp_ntz" else F.timestamp_micros("micros")
    return decided.select(F.col("key").cast(kinds[key]).alias(key), "request", when.alias(at), "passed")

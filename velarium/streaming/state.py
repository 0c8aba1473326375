"""Keyed state in event-time order, kept by Spark between micro-batches and restarts.

Rows of a key wait, as list state, until the watermark has passed them; then
they go, in order of time and id, through a fold whose own state is a small
value.  Event-time timers wake a key when its next row is due, or when what it
has open expires.  What a fold gives therefore depends on the events alone and
not on how they are cut into batches, as long as none is later than the
watermark's delay (Spark drops those).  A key holds the rows of one delay, no
more.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType


class InOrder(StatefulProcessor):
    """Rows (at in microseconds, id, value) of a key in order; subclasses define ``state``, ``step`` and ``expired``."""

    state: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, value string")
        self.held = handle.getValueState("held", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(a), int(i), v) for frame in rows for a, i, v in zip(frame["at"], frame["id"], frame["value"], strict=True)]
        if new:
            self.waiting.appendList(new)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        rows = sorted(((r[0], r[1], r[2]) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] // 1000 < watermark]
        out: list[tuple] = []
        for row in ready:
            held = self.step(held, row, out)
        left = rows[len(ready) :]
        if held is not None:
            due = self.expires(held)
            if watermark * 1000 > due:  # whatever comes is later
                self.expired(held, out)
                held = None
            else:
                self.handle.registerTimer(due // 1000 + 1)
        if ready:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        if left:
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        if out:
            yield pd.DataFrame([(*key, *o) for o in out], columns=["key", *self.fields])

    def close(self) -> None:
        pass


class Runs(InOrder):
    """Runs of equal values: value, first, last, n.  A run ends with another value, or after ``idle`` microseconds without a row."""

    state = "value string, first long, last long, n long"
    fields = ("value", "first", "last", "n")

    def __init__(self, idle: int):
        self.idle = idle

    def step(self, held, row, out):
        at, _, value = row
        if held is not None and (held[0] != value or at - held[2] > self.idle):
            out.append(held)
            held = None
        return (value, held[1], at, held[3] + 1) if held else (value, at, at, 1)

    def expires(self, held) -> int:
        return held[2] + self.idle

    def expired(self, held, out) -> None:
        out.append(held)


class InFlight(InOrder):
    """Rows that are let through: value, first (their time), last (when their id is free again), n (repeats dropped meanwhile).

    An id is in flight for ``span`` microseconds from the row that was let
    through; its repeats are counted and dropped until then.
    """

    state = Runs.state
    fields = Runs.fields

    def __init__(self, span: int):
        self.span = span

    def step(self, held, row, out):
        at, _, value = row
        if held is not None and at < held[2]:
            return (*held[:3], held[3] + 1)
        if held is not None:
            out.append(held)
        return (value, at, at + self.span, 0)

    def expires(self, held) -> int:
        return held[2]

    def expired(self, held, out) -> None:
        out.append(held)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which list state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def folded(stream: DataFrame, processor: InOrder, key: str, time: str, row_id: str, value: str, delay: str, folder: str) -> DataFrame:
    """What ``processor`` gives of a stream by ``key``, in order of ``time`` and ``row_id``, written as it comes.

    It runs until the input is used up and goes on from the checkpoint below
    ``folder`` when it is called again.  Rows without a key, time or id are left out.
    """
    kind = stream.schema[key].dataType
    shape = StructType([StructField("key", kind), StructField("value", StringType()), *[StructField(n, LongType()) for n in ("first", "last", "n")]])
    rows = stream.withWatermark(time, delay).where(F.col(key).isNotNull() & F.col(row_id).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("at"), F.col(row_id).cast("long").alias("id"), F.col(value).cast("string").alias("value"))
    out = rows.groupBy("key").transformWithStateInPandas(processor, shape, "append", "eventTime")
    with state_store(stream.sparkSession):
        query = out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(shape).parquet(f"{folder}/out")

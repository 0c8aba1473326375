"""Rows in a total order over all partitions, and digests of what a group says in that order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import cut

#: Rows that one task puts in order.
RUN = 65_536


def placed(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """Add ``place``, which rises with ``order`` over the whole table; written and read back.

    Equal rows are told apart by a number of their own, so neither a hot key
    nor many equal rows go to one task.  Places have gaps between partitions.
    """
    rows = cut(df.withColumn("_own", F.monotonically_increasing_id()))
    parts = max(1, -(-rows.count() // RUN))
    dealt = rows.repartitionByRange(parts, *order, F.col("_own")).sortWithinPartitions(*order, "_own")
    return cut(dealt.drop("_own").withColumn(place, F.monotonically_increasing_id()))


def numbered(rows: DataFrame, place: str = "place", number: str = "number") -> DataFrame:
    """Add ``number``, from 0 without gaps, to what ``placed`` gave."""
    part = F.shiftright(place, 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for RUN rows
    base = sizes.select("_p", before.alias("_before"))
    inside = F.col(place) - F.shiftleft(part, 33)
    return rows.join(base, part == F.col("_p")).withColumn(number, inside + F.col("_before")).drop("_p", "_before")


def joined_digests(df: DataFrame, group: str, order: str, piece: str, separator: str) -> DataFrame:
    """``group`` and sha256: that of its pieces in order with ``separator`` between them.

    A digest is sequential, so one task reads a group; it holds a batch of it.
    """
    rows = df.select(group, order, piece)
    schema = StructType([rows.schema[group], StructField("sha256", StringType())])
    mark = separator.encode()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            kind_of = batch.schema.field(0).type
            ended: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        ended.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(mark)
                state.update(text.encode())
            yield pa.record_batch([pa.array([k for k, _ in ended], kind_of), pa.array([d for _, d in ended], pa.string())], names=[group, "sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([key], kind_of), pa.array([state.hexdigest()], pa.string())], names=[group, "sha256"])

    return rows.repartition(group).sortWithinPartitions(group, order).mapInArrow(digests, schema)

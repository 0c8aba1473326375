"""Vector files as a Spark data source, in batch and as a stream.

``spark.read.format("vectors").option("layout", "fbin").load(path)`` and
``df.write.format("vectors").option("layout", ...)``.  Layouts (little-endian,
case-insensitive names): ``fbin`` (int32 rows, int32 dim, float32 rows*dim),
``fvecs`` (each row: int32 dim, dim floats), ``ivecs`` (each row: int32 k, k
int32) and ``ibin`` (int32 rows, int32 k, uint32 rows*k).  Sizes are checked
against the header, each row of the ``vecs`` layouts against the first, and a
file is read in row ranges, one partition each.  A DataFrame read from several
files numbers rows from 0 in file-name order.  Comparisons of ``vec_id`` with
numbers are pushed down: they become row ranges, files and rows outside them
are never opened, and Spark need not filter again.  The options ``start`` and
``count`` ask for a row range in the same way.

A writer's task streams its rows, in Arrow batches, into one file, which is
published under its name when complete; names rise with each append.  A stream
writes each micro-batch under its number and then notes the number in
``_committed``: files of a batch that is not noted are not read, and a batch
that is repeated after a crash replaces what it left, so every row is there
once.  A stream reads whole published files; its offset is the last file's
name and the rows so far, and a file that appears before it is an error.
"""

from __future__ import annotations

import os
import re
import struct
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FLOATS, WHOLE = ("fbin", "fvecs"), ("ibin", "ivecs")
ROWS = 100_000
#: Names of a streamed batch's files, and the folder that notes complete batches.
STREAMED, NOTED = re.compile(r"batch-(\d{9})-"), "_committed"
#: The least and the greatest row number.
ALL = (0, 1 << 62)


def _open(path: str):
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[str]:
    from pyarrow import fs

    store, at = _open(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    root = path.rstrip("/")
    names = sorted(os.path.basename(f.path) for f in store.get_file_info(fs.FileSelector(at)) if f.is_file)
    noted = {os.path.basename(f.path) for f in store.get_file_info(fs.FileSelector(f"{at.rstrip('/')}/{NOTED}", allow_not_found=True))}
    return [f"{root}/{n}" for n in names if not n.startswith((".", "_")) and ((m := STREAMED.match(n)) is None or m[1] in noted)]


def header(path: str, layout: str) -> tuple[int, int]:
    """Rows and dimension; the file's size has to fit them."""
    store, at = _open(path)
    size = store.get_file_info(at).size
    if size == 0 and layout.endswith("vecs"):
        return 0, 0
    if size < (8 if layout.endswith("bin") else 4):
        raise ValueError(f"{path}: too short for a header")
    with store.open_input_file(at) as f:
        if layout.endswith("bin"):
            rows, dim = struct.unpack("<ii", f.read(8))
            want = 8 + 4 * rows * dim
        else:
            (dim,) = struct.unpack("<i", f.read(4))
            rows = size // (4 + 4 * dim) if dim > 0 else 0
            want = rows * (4 + 4 * dim)
    if dim <= 0 or rows < 0 or (rows == 0 and layout.endswith("bin") and dim < 0):
        raise ValueError(f"{path}: rows and dimension have to be positive, not {rows} and {dim}")
    if size != want:
        raise ValueError(f"{path}: {size} bytes where {rows} rows of {dim} need {want}")
    return rows, dim


def read_rows(path: str, layout: str, dim: int, start: int, count: int) -> np.ndarray:
    store, at = _open(path)
    kind = "<f4" if layout in FLOATS else "<u4" if layout == "ibin" else "<i4"
    with store.open_input_file(at) as f:
        if layout.endswith("bin"):
            f.seek(8 + 4 * dim * start)
            return np.frombuffer(f.read(4 * dim * count), kind).reshape(count, dim)
        f.seek((4 + 4 * dim) * start)
        raw = np.frombuffer(f.read((4 + 4 * dim) * count), "<i4").reshape(count, dim + 1)
    bad = np.flatnonzero(raw[:, 0] != dim)
    if len(bad):
        raise ValueError(f"{path}: row {start + int(bad[0])} has dimension {int(raw[bad[0], 0])}, not {dim}")
    return raw[:, 1:].view(kind)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    dim: int
    start: int
    count: int


def _met(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts that two lists of row ranges (first, last) have in common."""
    return sorted((max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b if max(x[0], y[0]) <= min(x[1], y[1]))


def ranges_of(f: ds.Filter) -> list[tuple[int, int]] | None:
    """Row ranges of a filter on ``vec_id``; None of one that has to be left to Spark."""
    if getattr(f, "attribute", None) != ("vec_id",):
        return None
    if isinstance(f, ds.IsNotNull):
        return [ALL]
    if isinstance(f, ds.In):
        wanted = sorted({v for v in f.value if v is not None})
        return [(v, v) for v in wanted] if all(isinstance(v, int) for v in wanted) else None
    if not isinstance(getattr(f, "value", None), int):
        return None
    v = f.value
    kinds = ((ds.EqualTo, (v, v)), (ds.EqualNullSafe, (v, v)), (ds.GreaterThan, (v + 1, ALL[1])), (ds.GreaterThanOrEqual, (v, ALL[1])), (ds.LessThan, (0, v - 1)), (ds.LessThanOrEqual, (0, v)))
    return next((_met([r], [ALL]) for kind, r in kinds if isinstance(f, kind)), None)


def partitions_of(files: list[str], layout: str, rows: int, base: int, wanted: list[tuple[int, int]]) -> list[Range]:
    """Row ranges of at most ``rows`` rows over the wanted parts of the files, whose rows are numbered from ``base``."""
    out = []
    for path in files:
        n, dim = header(path, layout)
        for first, last in _met(wanted, [(base, base + n - 1)]):
            out += [Range(path, base, dim, a, min(rows, last - base + 1 - a)) for a in range(first - base, last - base + 1, rows)]
        base += n
    return out


def read_batches(p: Range, layout: str) -> Iterator[pa.RecordBatch]:
    name, kind = ("embedding", pa.float32()) if layout in FLOATS else ("neighbors", pa.int64())
    for a in range(p.start, p.start + p.count, 4096):
        n = min(4096, p.start + p.count - a)
        values = pa.array(read_rows(p.path, layout, p.dim, a, n).ravel()).cast(kind)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * p.dim)
        ids = pa.array(np.arange(n, dtype=np.int64) + p.first + a)
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, values)], ["vec_id", name])


class VectorReader(DataSourceReader):
    def __init__(self, path: str, layout: str, rows: int, start: int = 0, count: int | None = None):
        self.path, self.layout, self.rows = path, layout, rows
        self.wanted = _met([(start, ALL[1] if count is None else start + count - 1)], [ALL])

    def partitions(self) -> list[Range]:
        return partitions_of(files_of(self.path), self.layout, self.rows, 0, self.wanted) or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_batches(partition, self.layout)


class PushedReader(VectorReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        for f in filters:
            found = ranges_of(f)
            if found is None:
                yield f
            else:
                self.wanted = _met(self.wanted, found)


class VectorStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, layout: str, rows: int):
        self.path, self.layout, self.rows = path, layout, rows

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        files = files_of(self.path)
        return {"file": os.path.basename(files[-1]) if files else "", "rows": sum(header(f, self.layout)[0] for f in files)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = [f for f in files_of(self.path) if os.path.basename(f) <= end["file"]]
        old = [f for f in files if os.path.basename(f) <= start["file"]]
        if sum(header(f, self.layout)[0] for f in old) != start["rows"]:
            raise ValueError(f"{self.path}: files up to {start['file']} have changed since they were read")
        return partitions_of(files[len(old) :], self.layout, self.rows, start["rows"], [ALL]) or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_batches(partition, self.layout)


@dataclass
class Written(WriterCommitMessage):
    part: int
    temporary: str


def _write(path: str, layout: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """Streams the rows of a task into a hidden file; the header's count goes in at the end."""
    from pyspark import TaskContext

    store, at = _open(path)
    store.create_dir(at, recursive=True)
    part, temporary, rows, dim = TaskContext.get().partitionId(), f"{at}/.{uuid.uuid4().hex}", 0, None
    kind, flat = "<f4" if layout in FLOATS else "<u4" if layout == "ibin" else "<i4", layout.endswith("bin")
    with store.open_output_stream(temporary) as f:
        if flat:
            f.write(bytes(8))
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(next(n for n in ("embedding", "neighbors") if n in batch.schema.names))
            if column.null_count or column.flatten().null_count:
                raise ValueError("a null vector or component")
            sizes = np.diff(column.offsets.to_numpy())
            dim = int(sizes[0]) if dim is None else dim
            if (sizes != dim).any():
                raise ValueError(f"vectors of {int(sizes[sizes != dim][0])} and {dim} dimensions in one file")
            values = column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            f.write(values.tobytes() if flat else np.hstack([np.full((len(values), 1), dim, "<i4"), values.view("<i4")]).tobytes())
            rows += len(values)
    if not rows:
        store.delete_file(temporary)
        return Written(part, "")
    if flat:
        _put_header(store, temporary, struct.pack("<ii", rows, dim))
    return Written(part, temporary)


def _put_header(store, path: str, head: bytes) -> None:
    """Over the first bytes of a file; stores that only append get the file once more, block by block."""
    if store.type_name == "local":
        with open(path, "r+b") as f:
            f.write(head)
        return
    with store.open_input_stream(path) as old, store.open_output_stream(f"{path}.new") as new:
        old.read(len(head))
        new.write(head)
        while block := old.read(8 << 20):
            new.write(block)
    store.delete_file(path)
    store.move(f"{path}.new", path)


class _Publisher:
    def __init__(self, path: str, layout: str):
        self.path, self.layout, self.stamp = path, layout, f"{time.time_ns():020d}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, self.layout, iterator)

    def _publish(self, messages, name: str) -> None:
        store, at = _open(self.path)
        for m in messages:
            if m is not None and m.temporary:
                store.move(m.temporary, f"{at}/{name}-{m.part:05d}.{self.layout}")

    def _discard(self, messages) -> None:
        store, _ = _open(self.path)
        for m in messages:
            if m is not None and m.temporary:
                store.delete_file(m.temporary)


class VectorWriter(_Publisher, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self._publish(messages, f"part-{self.stamp}")

    def abort(self, messages) -> None:
        self._discard(messages)


class VectorStreamWriter(_Publisher, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        from pyarrow import fs

        store, at = _open(self.path)
        note = f"{at}/{NOTED}/{batchId:09d}"
        if store.get_file_info(note).type == fs.FileType.File:  # repeated after its commit
            return self._discard(messages)
        if store.get_file_info(at).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(at)):
                if os.path.basename(f.path).startswith(f"batch-{batchId:09d}-"):  # left by a commit that did not end
                    store.delete_file(f.path)
        self._publish(messages, f"batch-{batchId:09d}")
        store.create_dir(f"{at}/{NOTED}", recursive=True)
        with store.open_output_stream(note) as f:
            f.write(b"")

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self._discard(messages)


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def _layout(self) -> str:
        layout = self.options.get("layout", "fbin").lower()
        if layout not in FLOATS + WHOLE:
            raise ValueError(f"unknown layout {layout}")
        return layout

    def schema(self) -> str:
        return "vec_id long, embedding array<float>" if self._layout() in FLOATS else "vec_id long, neighbors array<long>"

    def reader(self, schema: StructType) -> VectorReader:
        count, kind = self.options.get("count"), PushedReader if self.options.get("push", "false").lower() == "true" else VectorReader
        return kind(self.options["path"], self._layout(), int(self.options.get("rows", ROWS)), int(self.options.get("start", 0)), None if count is None else int(count))

    def streamReader(self, schema: StructType) -> VectorStreamReader:  # noqa: N802
        return VectorStreamReader(self.options["path"], self._layout(), int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options["path"], self._layout())

    def streamWriter(self, schema: StructType, overwrite: bool) -> VectorStreamWriter:  # noqa: N802
        return VectorStreamWriter(self.options["path"], self._layout())


@contextmanager
def pushdown(spark: SparkSession) -> Iterator[None]:
    """Filters on ``vec_id`` reach the files in actions that run inside, of DataFrames loaded with the option ``push``."""
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorSource)


def fnv1a64(data: bytes) -> int:
    """The FNV-1a fingerprint of a file's payload."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


#: The files of a bundle and their layouts.
BUNDLE = {"base": "fbin", "queries": "fbin", "truth": "ibin"}


def write_bundle(base: DataFrame, queries: DataFrame, truth: DataFrame, folder: str) -> None:
    """Base (vec_id, embedding), queries (qid, query) and ground truth (qid, rank, vec_id) as one file each, in id order."""
    neighbors = truth.groupBy(F.col("qid").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("neighbors"))
    as_float = lambda c: F.col(c).cast("array<float>").alias("embedding")
    parts = {"base": base.select("vec_id", as_float("embedding")), "queries": queries.select(F.col("qid").alias("vec_id"), as_float("query")), "truth": neighbors}
    for name, layout in BUNDLE.items():
        parts[name].coalesce(1).sortWithinPartitions("vec_id").write.format("vectors").mode("append").option("layout", layout).save(f"{folder}/{name}")


class VectorFile:
    """A vector file on a local store, mapped: only the rows that are asked for are read."""

    def __init__(self, path: str, layout: str):
        self.rows, self.dim = header(path, layout)
        store, at = _open(path)
        if store.type_name != "local":
            raise ValueError(f"not a local file: {path}")
        kind = {"fbin": "<f4", "fvecs": "<f4", "ibin": "<u4", "ivecs": "<i4"}[layout]
        if layout.endswith("bin"):
            self._all = np.memmap(at, kind, "r", 8, (self.rows, self.dim)) if self.rows else np.zeros((0, self.dim), kind)
        else:  # each row has its dimension in front
            self._all = np.memmap(at, kind, "r", 0, (self.rows, self.dim + 1))[:, 1:] if self.rows else np.zeros((0, self.dim), kind)

    def slice(self, start: int, stop: int) -> np.ndarray:
        if not 0 <= start <= stop <= self.rows:
            raise IndexError(f"rows {start} to {stop} of {self.rows}")
        return np.array(self._all[start:stop])

    def rows_at(self, places) -> np.ndarray:
        places = np.asarray(places, np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.rows):
            raise IndexError(f"a row outside the file's {self.rows}")
        return np.array(self._all[places])

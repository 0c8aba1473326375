"""Token-ID output: flat unsigned integers and 64-bit document offsets.

The rows are range-partitioned by id.  Each task encodes its documents and
writes three files:

    part-NNNNN.ids      unsigned ids, one document after another: 16 bits wide
                        if the vocabulary has no more ids than that, else 32
    part-NNNNN.offsets  n+1 unsigned 64-bit offsets into it, in ids
    part-NNNNN.docs     n signed 64-bit document ids, 0 where there is none

all little-endian.  A file appears under its name only when it is complete, so
a task that runs twice leaves one result.  A manifest holds each part's counts
(``n_null``: its first documents, which have no id) and width; prefix sums over
the parts give the bases at which they begin in the whole.  Readers memory-map
local files and read other stores through Arrow's filesystem of the path's
scheme; a folder without one is where Spark's default store has it.

Defined cases: null texts are empty and give the end id alone; null ids come
first, and every 64-bit number is an id; repeated ids stand side by side,
ordered by text; further columns, whatever their names, are not read; an empty
table gives no parts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import qualified, small_batches
from .wordbpe import encoder, runs

#: Bytes of text that a part holds, parts at most (beyond, parts grow), and parts whose sums one task adds up.
PART, PARTS, GROUP = 24 << 20, 20_000, 1024
KINDS = ("ids", "offsets", "docs")


def _store(folder: str):
    from pyarrow import fs

    if urlparse(folder).scheme == "file":
        return fs.LocalFileSystem(), unquote(urlparse(folder).path)
    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, base = _store(folder)
        temporary = {kind: f"{base}/.{attempt}.{kind}" for kind in KINDS}
        codec = encoder(tokenizer)
        width = 2 if max(codec.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        streams, n_docs, n_null, n_tokens = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if streams is None:
                files.create_dir(base, recursive=True)
                streams = {kind: files.open_output_stream(path) for kind, path in temporary.items()}
                streams["offsets"].write(np.zeros(1, "<u8").tobytes())
            for a, b in runs(batch.column("text")):
                ids, ends = codec.encode(batch.column("text").slice(a, b - a))
                streams["ids"].write(np.insert(ids, ends, end_id).astype(f"<u{width}").tobytes())
                ends = n_tokens + ends + np.arange(1, b - a + 1)
                streams["offsets"].write(ends.astype("<u8").tobytes())
                n_tokens = int(ends[-1])
            streams["docs"].write(np.asarray(pc.fill_null(batch.column("doc_id"), 0), "<i8").tobytes())
            n_docs, n_null = n_docs + batch.num_rows, n_null + batch.column("doc_id").null_count
        if streams is None:
            return
        for kind, stream in streams.items():
            stream.close()
            files.move(temporary[kind], f"{base}/part-{part:05d}.{kind}")
        row = {"part": part, "n_docs": n_docs, "n_null": n_null, "n_tokens": n_tokens, "width": width}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    return run


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Encode and write every row; gives the manifest (part, n_docs, n_null, n_tokens, width, first_doc, base), also stored below the folder."""
    spark = df.sparkSession
    folder = qualified(spark, folder)
    rows = df.select(F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    ordered = rows.repartitionByRange(max(8, min(PARTS, -(-total // PART))), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = ordered.mapInArrow(_writer(folder, tokenizer, end_id), "part int, n_docs long, n_null long, n_tokens long, width int")
    with small_batches(spark):
        made.write.parquet(f"{folder}/parts")
    # Prefix sums in two steps: inside groups of parts, and over the groups' sums.
    counted = spark.read.parquet(f"{folder}/parts").withColumn("group", F.floor(F.col("part") / GROUP))
    sums = ("n_docs", "first_doc"), ("n_tokens", "base")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counted.groupBy("group").agg(*[F.sum(c).alias(c) for c, _ in sums])
    groups = groups.select(F.col("group").alias("_g"), *[before(Window.orderBy("group"), c).alias(f"_{n}") for c, n in sums])
    inside = counted.select("*", *[before(Window.partitionBy("group").orderBy("part"), c).alias(n) for c, n in sums])
    bases = inside.join(groups, F.col("group") == F.col("_g")).select("part", "n_docs", "n_null", "n_tokens", "width", *[(F.col(n) + F.col(f"_{n}")).alias(n) for _, n in sums])
    bases.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def mapped(folder: str, part: int, kind: str, width: int = 4) -> np.ndarray:
    """A part's file as an array (ids of ``width`` bytes): memory-mapped where the store is local."""
    files, base = _store(folder)
    path, dtype = f"{base}/part-{part:05d}.{kind}", {"ids": f"<u{width}", "offsets": "<u8", "docs": "<i8"}[kind]
    if files.type_name == "local":
        return np.memmap(path, dtype, "r")
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, width, n_null in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "width", "n_null")), strict=True):
                ids, offsets, docs = (mapped(folder, part, kind, width) for kind in KINDS)
                at = offsets.astype(np.int64)
                for a in range(0, len(docs), 4096):
                    b = min(a + 4096, len(docs))
                    crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4")) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[a:b].astype(np.int64), mask=np.arange(a, b) < n_null), pa.array(base + at[a:b]), pa.array(np.diff(at[a : b + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of its ids, of each document in the files."""
    folder = qualified(spark, folder)
    manifest = spark.read.parquet(f"{folder}/manifest")
    parts = max(1, manifest.count())
    return manifest.select("part", "base", "width", "n_null").repartition(parts, "part").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")

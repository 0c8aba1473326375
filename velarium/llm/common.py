"""Reading inputs, cutting lineage and small column helpers shared by the operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contract: space and \x09-\x0D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``, with its scheme.

    Only a session inside one machine (tests, notebooks) may leave that unset:
    it gets a temporary folder.  Folders are deleted when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="velarium-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = qualified(spark, f"{base.rstrip('/')}/velarium-{uuid.uuid4().hex}")
    atexit.register(_delete, spark, path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and place that Spark gives it, for readers and writers beside Spark."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session or its gateway is gone already
        pass


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches bounded in rows and bytes while an action runs: a task that hands texts to Python holds little of them at once."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
    before = {k: spark.conf.get(k) for k in bounds}
    for k, v in bounds.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Later jobs start from that table, so neither a lost executor nor a second
    consumer makes Spark repeat what came before.
    """
    path = shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def carried(columns: list[str]) -> Column:
    """The caller's columns as one struct, so that none can clash with an operator's own; :func:`given_back` takes them out."""
    return F.struct(F.lit(0).alias("none"), *[F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(columns)])


def given_back(columns: list[str], name: str) -> list[Column]:
    return [F.col(name).getField(f"c{i}").alias(c) for i, c in enumerate(columns)]

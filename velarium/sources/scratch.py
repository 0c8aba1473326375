"""Intermediate files below the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh folder, with its scheme, deleted when the driver ends.  Only a session inside one machine may leave the setting out."""
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


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into a shared folder and read it back: later jobs start from that table."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

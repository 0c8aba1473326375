"""Structured Streaming forms of the stateful operators.

Each function takes a streaming DataFrame and a folder for its checkpoint and
results, runs until the input is used up, and gives the result as a batch
DataFrame.  Results go to Parquet, not to the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, sketches
from ..operators.search import knn, ranked


def replay(df: DataFrame, folder: str, files: int) -> DataFrame:
    """A batch table as a stream of ``files`` micro-batches."""
    df.repartition(files).write.parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def replay_in_order(df: DataFrame, folder: str, by: str, files: int) -> DataFrame:
    """A batch table as a stream of ``files`` micro-batches, by quantiles of the time ``by``; each is written after the one before."""
    x = F.unix_micros(by)
    edges = df.select(x.cast("double").alias("x")).approxQuantile("x", [k / files for k in range(1, files)], 0.01)
    place = sum(((x > e).cast("int") for e in edges), F.lit(0))
    for k in range(files):
        df.where(place == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _run(stream: DataFrame, folder: str, mode: str, batch) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _last(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The newest state a batch has written."""
    return spark.read.schema(schema).parquet(f"{folder}/{max(_states(spark, folder))}") if _states(spark, folder) else spark.createDataFrame([], schema)


def _states(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("state-")) if fs.exists(at) else []


def topk(stream: DataFrame, queries: DataFrame, k: int, folder: str) -> DataFrame:
    """The running k nearest of each query over base batches: each batch's hits merge with the state before it."""
    schema = "qid long, vec_id long, d double"

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = knn(batch.select("vec_id", "embedding"), queries, k).select("qid", "vec_id", "d")
        old = [s for s in _states(spark, folder) if s < f"state-{number:09d}"]
        if old:
            new = new.unionByName(spark.read.schema(schema).parquet(f"{folder}/{old[-1]}"))
        ranked(new, k).select("qid", "vec_id", "d").write.mode("overwrite").parquet(f"{folder}/state-{number:09d}")

    _run(stream, folder, "append", merge)
    return ranked(_last(stream.sparkSession, folder, schema), k)


def to_files(stream: DataFrame, layout: str, path: str, folder: str) -> None:
    """Arriving vectors as files of a layout, each batch noted when it is complete."""
    out = stream.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).writeStream.format("vectors").option("layout", layout)
    out.option("path", path).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, level, folder: str) -> DataFrame:
    """Appends arriving vectors, with their level, to an index's node table; a batch that is replayed replaces itself."""

    def append(batch: DataFrame, number: int) -> None:
        level(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/nodes/b={number}")

    _run(stream, folder, "append", append)
    return stream.sparkSession.read.parquet(f"{folder}/nodes").drop("b")


def indexed(stream: DataFrame, folder: str, m: int = 8, ef: int = 32) -> graph.Index:
    """A graph index of arriving vectors: the first batch builds it, each later one is inserted into the parts it meets.

    Every batch saves its index, so a batch that is replayed starts from the one before it.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = [s for s in _states(spark, folder) if s < f"state-{number:09d}"]
        index = graph.insert(graph.load(spark, f"{folder}/{old[-1]}"), batch) if old else graph.build(batch, m, ef)
        graph.save(index, f"{folder}/state-{number:09d}", "overwrite")

    _run(stream, folder, "append", add)
    return graph.load(stream.sparkSession, f"{folder}/{max(_states(stream.sparkSession, folder))}")


def batch_sizes(stream: DataFrame, folder: str) -> DataFrame:
    """batch and n: the rows of each micro-batch, which the source's rate limit bounds."""

    def put(batch: DataFrame, number: int) -> None:
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/sizes/batch={number}")

    _run(stream, folder, "append", put)
    return stream.sparkSession.read.schema("n long, batch long").parquet(f"{folder}/sizes")


def sketch_states(stream: DataFrame, time: str, width: str, who: str, value: str, folder: str) -> DataFrame:
    """The state table of :mod:`~velarium.operators.sketches`, to which every micro-batch adds its own rows; a replayed batch replaces them."""

    def put(batch: DataFrame, number: int) -> None:
        sketches.sketched(batch, time, width, who, value).write.mode("overwrite").parquet(f"{folder}/sketches/batch={number}")

    _run(stream, folder, "append", put)
    return stream.sparkSession.read.parquet(f"{folder}/sketches").drop("batch")


def latency(stream: DataFrame, key: str, value: str, folder: str) -> DataFrame:
    """Running count, mean and maximum of each key."""
    running = stream.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state-{number:09d}")

    _run(running, folder, "complete", put)
    return _last(stream.sparkSession, folder, running.schema)


def deduplicated(stream: DataFrame, row_id: str, time: str, delay: str, folder: str) -> DataFrame:
    """Rows whose id was not seen within the watermark's delay."""
    out = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([row_id])
    query = out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed(stream: DataFrame, time: str, width: str, delay: str, keys: list[str], folder: str) -> DataFrame:
    """Approximate distinct users and counts of tumbling windows, late rows dropped by the watermark; the last state of each window."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/updates/b={number}")

    _run(w, folder, "update", put)
    u = stream.sparkSession.read.parquet(f"{folder}/updates").drop("b")
    return u.groupBy("w", *keys).agg(F.max_by("n", "number").alias("n"), F.max_by("users", "number").alias("users"))

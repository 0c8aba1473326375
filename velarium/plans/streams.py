"""File round trips and streaming queries; their oracles are the batch equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, sampling, search, sketches
from ..sources.scratch import cut, folder
from ..sources.vectors import pushdown, register
from ..streaming import jobs, state
from . import sqlnum as s
from .graphs import M
from .vectors import asked, vectors

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


WHOLE = "SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding FROM embeddings)"


def _roundtrip(spark, sf_dir, layout: str) -> DataFrame:
    register(spark)
    path = folder(spark)
    v = vectors(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<float>"))
    v.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").write.format("vectors").mode("append").option("layout", layout).save(path)
    back = spark.read.format("vectors").option("layout", layout).option("rows", 64).load(path)
    return back.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query(WHOLE)
def fbin_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "fbin")


@query(WHOLE)
def fvecs_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "fvecs")


@query("SELECT qid AS vec_id, n::INTEGER AS n, k::INTEGER AS rank, vec_id AS neighbor FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS k, dense_rank() OVER (ORDER BY qid) - 1 AS n FROM ({p})) WHERE k <= 5".format(p=s.all_pairs("fp32")))
def ibin_roundtrip(spark, sf_dir):
    """A ground-truth matrix written and read back."""
    register(spark)
    path, base = folder(spark), vectors(spark, sf_dir)
    truth = search.knn(base, asked(base), 5).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("neighbors"))
    truth.select(F.col("qid").alias("vec_id"), "neighbors").coalesce(1).sortWithinPartitions("vec_id").write.format("vectors").mode("append").option("layout", "ibin").save(path)
    back = spark.read.format("vectors").option("layout", "ibin").load(path)
    return back.select((F.col("vec_id") * 25).alias("vec_id"), F.col("vec_id").cast("int").alias("n"), F.posexplode("neighbors").alias("rank", "neighbor")).withColumn("rank", F.col("rank") + 1)


@query("WITH n AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, embedding, count(*) OVER () AS n FROM embeddings) SELECT place, i::INTEGER AS i, round(x, 6) AS x FROM (SELECT place, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM n WHERE place BETWEEN n // 4 AND n // 2 OR place IN (1, n - 1))")
def vector_range(spark, sf_dir):
    """A quarter of a file's rows and two single ones: the predicate becomes row ranges, nothing else is read."""
    register(spark)
    path, v = folder(spark), vectors(spark, sf_dir)
    v.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id").write.format("vectors").mode("append").option("layout", "fbin").save(path)
    n, load = v.count(), lambda: spark.read.format("vectors").option("rows", 64).option("push", True).load(path)
    with pushdown(spark):
        middle, ends = load().where(F.col("vec_id").between(n // 4, n // 2)), load().where(F.col("vec_id").isin(1, n - 1))
        wanted = cut(middle.unionByName(ends).dropDuplicates(["vec_id"]))
    return wanted.select(F.col("vec_id").alias("place"), F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query(s.topk(s.all_pairs("fp32"), 10))
def stream_topk_files(spark, sf_dir):
    """The running nearest over a folder of vector files that grows between three runs of one stream."""
    register(spark)
    base, at = vectors(spark, sf_dir), folder(spark)
    numbered = cut(sampling.dense_index(base, "vec_id", "place"))
    third, hits = -(-base.count() // 3), None
    for k in range(3):
        part = numbered.where(F.floor(F.col("place") / third) == k).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
        part.repartitionByRange(2, "vec_id").sortWithinPartitions("vec_id").write.format("vectors").mode("append").option("layout", "fbin").save(f"{at}/in")
        hits = jobs.topk(spark.readStream.format("vectors").option("layout", "fbin").load(f"{at}/in"), asked(base), 10, at)
    named = hits.withColumnRenamed("vec_id", "place").join(numbered.select("vec_id", "place"), "place")
    return named.select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", (F.round(F.col("d") + 1e-12, 6) + 0.0).alias("d"))


@query("SELECT i::INTEGER AS i, round(x, 6) AS x, count(*) AS n FROM (SELECT unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def stream_vector_sink(spark, sf_dir):
    """Vectors that arrive in three batches, written to files as they come; every component is there as often as it was."""
    register(spark)
    at = folder(spark)
    jobs.to_files(jobs.replay(vectors(spark, sf_dir), at, 3), "fvecs", f"{at}/out", at)
    back = spark.read.format("vectors").option("layout", "fvecs").load(f"{at}/out")
    x = F.round(F.col("x").cast("double"), 6).alias("x")
    return back.select(F.posexplode("embedding").alias("i", "x")).select("i", x).groupBy("i", "x").agg(F.count("*").alias("n"))


@query(s.topk(s.all_pairs("fp32"), 10))
def stream_topk(spark, sf_dir):
    base, at = vectors(spark, sf_dir), folder(spark)
    hits = jobs.topk(jobs.replay(base, at, 3), asked(base), 10, at)
    return hits.select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", (F.round(F.col("d") + 1e-12, 6) + 0.0).alias("d"))


@query("SELECT level, count(*) AS n FROM (SELECT floor(-ln((('0x' || substr(md5(vec_id || ':100'), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE) / ln(8))::INTEGER AS level FROM embeddings) GROUP BY level")
def stream_ingest(spark, sf_dir):
    base, at = vectors(spark, sf_dir), folder(spark)
    nodes = jobs.ingest(jobs.replay(base, at, 3), lambda batch: graph.levels(batch, M), at)
    return nodes.groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS nodes, 0::BIGINT AS self_loops, 0::BIGINT AS repeated, 0::BIGINT AS overfull, 0::BIGINT AS astray, true AS searched FROM embeddings")
def stream_index(spark, sf_dir):
    """An index that three batches are inserted into: its nodes, its faults, and whether it finds 95 of 100 neighbours."""
    base, at = vectors(spark, sf_dir), folder(spark)
    index = jobs.indexed(jobs.replay(base, at, 3), at, M)
    recall = search.recall(graph.search(index, asked(base), 10), search.knn(base, asked(base), 10), 10)
    return graph.census(index).crossJoin(F.broadcast(recall.select((F.col("recall") >= 0.95).alias("searched"))))  # one row each


def events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type")
def stream_latency(spark, sf_dir):
    at = folder(spark)
    return jobs.latency(jobs.replay(events(spark, sf_dir), at, 3), "event_type", "value", at).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, sf_dir):
    """Every event arrives twice and counts once."""
    at, e = folder(spark), events(spark, sf_dir)
    twice = e.withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_n")
    return jobs.deduplicated(jobs.replay(twice, at, 1), "event_id", "ts", "1 hour", at).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS epoch_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Daily counts of a stream with a month's grace for late rows."""
    at = folder(spark)
    w = jobs.windowed(jobs.replay(events(spark, sf_dir), at, 3), "ts", "1 day", "40 days", ["event_type"], at)
    return w.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("epoch_us"), "event_type", "n")


@query("SELECT count(*) AS n, true AS bounded, 5::BIGINT AS batches FROM events")
def stream_rate_limit(spark, sf_dir):
    """A backlog of five files taken one at a time: all events arrive, and no batch has more than a file's."""
    at, e = folder(spark), events(spark, sf_dir)
    batches = jobs.batch_sizes(jobs.replay(e, at, 5), at)
    total = F.sum("n")
    return batches.agg(total.alias("n"), (F.max("n") <= total / 5 + 5).alias("bounded"), F.count("*").alias("batches"))


HOUR = 3_600_000_000


def _folded(spark, sf_dir, processor) -> DataFrame:
    """Events in three micro-batches; then a late heartbeat, for which the stream is started again, moves the watermark past all of them."""
    at, e = folder(spark), events(spark, sf_dir)
    args = (processor, "user_id", "ts", "event_id", "event_type", "2 hours", at)
    state.folded(jobs.replay_in_order(e, at, "ts", 3), *args)
    beat = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("beat").alias("event_type"), F.lit(0.0).alias("value"))
    beat.coalesce(1).write.mode("append").parquet(f"{at}/in")
    return state.folded(spark.readStream.schema(e.schema).parquet(f"{at}/in"), *args)


@query(
    "SELECT user_id, event_type AS value, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM "
    "(SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, run, event_type"
)
def stream_runs(spark, sf_dir):
    """Runs of one kind of event of each user, from keyed state over several batches and a restart; twelve hours of silence end a run."""
    return _folded(spark, sf_dir, state.Runs(12 * HOUR)).select(F.col("key").alias("user_id"), "value", F.col("first").alias("first_us"), F.col("last").alias("last_us"), "n")


@query(
    "WITH RECURSIVE a(user_id, ts, event_id, event_type) AS (SELECT user_id, x.ts, x.event_id, x.event_type FROM (SELECT user_id, min(struct_pack(ts := ts, event_id := event_id, event_type := event_type)) AS x FROM events GROUP BY user_id) UNION ALL "
    "SELECT user_id, x.ts, x.event_id, x.event_type FROM (SELECT a.user_id, min(struct_pack(ts := e.ts, event_id := e.event_id, event_type := e.event_type)) AS x FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 6 HOUR GROUP BY a.user_id, a.ts)) "
    "SELECT a.user_id, a.event_type AS value, epoch_us(a.ts) AS first_us, count(e.event_id) AS dropped FROM a LEFT JOIN events e ON e.user_id = a.user_id AND (e.ts, e.event_id) > (a.ts, a.event_id) AND e.ts < a.ts + INTERVAL 6 HOUR GROUP BY ALL"
)
def stream_in_flight(spark, sf_dir):
    """Users are in flight for six hours from an event that was let through; the events dropped meanwhile are counted."""
    return _folded(spark, sf_dir, state.InFlight(6 * HOUR)).select(F.col("key").alias("user_id"), "value", F.col("first").alias("first_us"), F.col("n").alias("dropped"))


@query(
    "WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(DISTINCT user_id) AS active FROM events GROUP BY 1) "
    "SELECT count(*) AS epochs, round(avg(active), 6) AS mean, (SELECT active::DOUBLE FROM (SELECT active, row_number() OVER (ORDER BY active) AS k FROM h) WHERE k = (SELECT ceil(count(*) * 0.95) FROM h)) AS percentile FROM h"
)
def epoch_activity(spark, sf_dir):
    """Distinct users of each hour: their mean and 95th percentile over the hours."""
    hours = sketches.active(events(spark, sf_dir), "ts", "1 hour", "user_id")
    return sketches.over_epochs(hours, "active").withColumn("mean", F.round("mean", 6))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS epoch_us, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_within, true AS ranks_within, true AS top_within FROM events GROUP BY 1")
def epoch_sketches(spark, sf_dir):
    """Hourly sketches of a stream's three batches, merged into days: each estimate is within its stated error of the exact one."""
    at, e = folder(spark), events(spark, sf_dir)
    state = jobs.sketch_states(jobs.replay(e, at, 3), "ts", "1 hour", "user_id", "value", at)
    day = F.date_trunc("day", F.col("epoch"))
    found = sketches.estimates(sketches.merged(state, day), [0.5, 0.95], 1).withColumnRenamed("epoch", "day")
    by_day = e.withColumn("day", F.date_trunc("day", F.col("ts")))
    counts = by_day.groupBy("day", "user_id").agg(F.count("*").alias("own"))
    exact = by_day.groupBy("day").agg(F.count_distinct("user_id").alias("users")).join(counts.groupBy("day").agg(F.max("own").alias("most")), "day")
    below = by_day.join(found.select("day", "quantiles"), "day").groupBy("day").agg(*[(F.count_if(F.col("value") <= F.col("quantiles")[i]) / F.count("*")).alias(f"r{i}") for i in (0, 1)], *[(F.count_if(F.col("value") < F.col("quantiles")[i]) / F.count("*")).alias(f"l{i}") for i in (0, 1)])
    near = [(F.col(f"r{i}") >= s - sketches.RANK) & (F.col(f"l{i}") <= s + sketches.RANK) for i, s in ((0, 0.5), (1, 0.95))]
    all_ = found.join(exact, "day").join(below, "day")
    listed = F.get("top", F.lit(0))["count"]  # nobody is listed where nobody stands out from the sketch's error
    return all_.select(
        F.unix_micros("day").alias("epoch_us"), "n", "users", (F.abs(F.col("active") - F.col("users")) <= F.greatest(F.lit(1), 4 * sketches.SPREAD * F.col("users"))).alias("users_within"),
        (near[0] & near[1]).alias("ranks_within"), (F.col("most") <= F.coalesce(listed, sketches.UNLISTED * F.col("n"))).alias("top_within"),
    )

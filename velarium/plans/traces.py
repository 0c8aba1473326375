"""Trace and counter queries: the events as an access trace.

rank = user_id % 32, clock = ts, service time = value, request type =
event_type, phase = props.k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.analytics import percentile_of
from ..sources.scratch import cut

QUERIES, ORACLES = {}, {}
#: Events of one moment are ordered by id.
ORDER = ["ts", "event_id"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumn("rank", F.pmod("user_id", F.lit(32)))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_counts(spark, sf_dir):
    return trace(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(coalesce(CASE WHEN avg(n) = 0 THEN 0 ELSE stddev_pop(n) / avg(n) END, 0), 6) AS cv FROM (SELECT event_type, user_id % 32 AS rank, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def cv_by_group(spark, sf_dir):
    """Population coefficient of variation of a type's requests over the ranks."""
    n = trace(spark, sf_dir).groupBy("event_type", "rank").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.round(F.when(F.avg("n") == 0, 0.0).otherwise(F.stddev_pop("n") / F.avg("n")), 6).alias("cv"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def p95_nearest_rank(spark, sf_dir):
    return percentile_of(trace(spark, sf_dir), ["event_type"], "value", {"p95": 0.95})


@query("SELECT least(floor(value / 10), 9)::INTEGER AS bin, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1")
def latency_histogram(spark, sf_dir):
    """Ten bins, the last one open."""
    return trace(spark, sf_dir).where("value >= 0").groupBy(F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_accessed(spark, sf_dir):
    return trace(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(10)


ISLANDS = "SELECT user_id, event_type, count(*) AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events) GROUP BY user_id, event_type, island"


@query(f"SELECT user_id, count(*) AS runs, round(avg(run), 6) AS mean_run, quantile_disc(run, 0.95) AS p95_run FROM ({ISLANDS}) GROUP BY user_id")
def run_lengths(spark, sf_dir):
    """Runs of equal request types of each user, in time order."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = trace(spark, sf_dir).withColumn("new", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("int"))
    runs = e.withColumn("island", F.sum("new").over(w)).groupBy("user_id", "island").agg(F.count("*").alias("run"))
    runs = cut(runs)
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.round(F.avg("run"), 6).alias("mean_run")).join(percentile_of(runs, ["user_id"], "run", {"p95_run": 0.95}), "user_id")


@query("SELECT event_type, max(n) AS hottest, sum(n)::BIGINT AS total, round(max(n) / sum(n), 6) AS share FROM (SELECT event_type, user_id % 32 AS rank, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def hottest_share(spark, sf_dir):
    n = trace(spark, sf_dir).groupBy("event_type", "rank").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.max("n").alias("hottest"), F.sum("n").alias("total"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("SELECT user_id % 4 AS channel, CASE WHEN grouping(user_id // 4 % 4) = 0 THEN user_id // 4 % 4 END AS bankgroup, round(sum((event_type = 'click')::INT) / count(*), 6) AS miss_ratio, count(*) AS reads FROM events GROUP BY GROUPING SETS ((user_id % 4), (user_id % 4, user_id // 4 % 4))")
def miss_ratio_grain(spark, sf_dir):
    """Miss ratios per channel and per bank group, in one pass over two grains."""
    e = trace(spark, sf_dir).select(F.pmod("user_id", F.lit(4)).alias("channel"), F.pmod(F.floor(F.col("user_id") / 4), F.lit(4)).alias("bankgroup"), (F.col("event_type") == "click").cast("int").alias("miss"))
    g = e.groupingSets([["channel"], ["channel", "bankgroup"]], "channel", "bankgroup")
    return g.agg(F.round(F.sum("miss") / F.count("*"), 6).alias("miss_ratio"), F.count("*").alias("reads"))


@query(
    "WITH RECURSIVE s AS MATERIALIZED (SELECT user_id % 32 AS rank, user_id AS u, row_number() OVER (PARTITION BY user_id % 32 ORDER BY ts, event_id) AS n FROM events), "
    "r(rank, k, cache, hits) AS (SELECT DISTINCT rank, 0::BIGINT, []::BIGINT[], 0 FROM s UNION ALL "
    "SELECT r.rank, s.n, list_append(list_filter(cache, lambda x: x <> s.u)[-15:], s.u), hits + list_contains(cache, s.u)::INT FROM r JOIN s ON s.rank = r.rank AND s.n = r.k + 1) "
    "SELECT rank, max(k) AS accesses, max(hits)::BIGINT AS hits, round(max(hits) / max(k), 6) AS hit_rate FROM r GROUP BY rank"
)
def lru_hit_rate(spark, sf_dir):
    """Hits of a 16-entry cache of users in each rank."""
    e = trace(spark, sf_dir)
    h = sampling.lru_hits(e, "rank", ORDER, "user_id", 16)
    return h.select(F.col("k").alias("rank"), "accesses", "hits", F.round(F.col("hits") / F.col("accesses"), 6).alias("hit_rate"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS epoch_us, count(DISTINCT user_id % 32) AS active FROM events GROUP BY 1")
def tumbling_active(spark, sf_dir):
    """Distinct active ranks in each hour."""
    e = trace(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.countDistinct("rank").alias("active"))
    return e.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("epoch_us"), "active")


@query("SELECT epoch_us(s) AS epoch_us, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    """Two-hour windows that start every hour."""
    e = trace(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("epoch_us"), "event_type", "n")


@query("SELECT epoch_us, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY epoch_us ORDER BY n DESC, user_id) AS k FROM (SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS epoch_us, user_id, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k <= 3")
def heavy_hitters_window(spark, sf_dir):
    """The three most frequent users of each day; counters start anew every day."""
    n = trace(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("w").orderBy(F.col("n").desc(), "user_id"))
    return n.withColumn("k", k).where("k <= 3").select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("epoch_us"), "user_id", "n")


@query("SELECT user_id, event_id, k AS running FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k % 8 = 0")
def threshold_trigger(spark, sf_dir):
    """Each event at which a user's exact counter reaches a multiple of 8."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER))
    return trace(spark, sf_dir).withColumn("running", k.cast("long")).where("running % 8 = 0").select("user_id", "event_id", "running")


@query("SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def session_events(spark, sf_dir):
    """Sessions that end after six hours without an event."""
    s = trace(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n")


@query("SELECT conv_id, role, count(*) AS run FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM conversations) GROUP BY conv_id, role, island")
def conversation_islands(spark, sf_dir):
    """Runs of turns of one role."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("island", F.sum((~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int")).over(w))
    return c.groupBy("conv_id", "island", "role").agg(F.count("*").alias("run")).select("conv_id", "role", "run")

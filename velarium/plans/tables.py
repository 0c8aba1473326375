"""Queries of files, catalogues and evaluation tables: sinks read back, policies, staged pruning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as a
from ..operators import sampling, search
from ..sources import catalogue, text, vectors as files
from ..sources.scratch import folder
from . import sqlnum as s
from .analytics import FRONTIER, points
from .vectors import COARSE, EVERY, K, asked, vectors

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sinks and scans: what is written comes back


@query("SELECT p_partkey, p_name, p_size FROM part")
def tsv_roundtrip(spark, sf_dir):
    """A headed table of declared types, written and scanned with the checks of columns, cells and emptiness."""
    at = folder(spark)
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.csv(at, sep="\t", header=True)
    return text.delimited(spark, at, "p_partkey long, p_name string, p_size int")


@query("SELECT r_name, 'fp' || r_regionkey AS metric, 10 * r_regionkey AS ef FROM region")
def settings_scan(spark, sf_dir):
    """The first ``key: value`` of settings files, comments and later repeats passed over."""
    at = folder(spark)
    lines = F.concat_ws("\n", F.lit("# settings"), F.concat(F.lit("  name: "), "r_name"), F.concat(F.lit("metric:  fp"), "r_regionkey", F.lit("  # metric: none")), F.concat(F.lit("ef : "), 10 * F.col("r_regionkey")), F.lit("ef: 7"))
    table(spark, sf_dir, "region").select(F.regexp_replace("r_name", " ", "_").alias("r_name"), "r_regionkey").select(lines.alias("value"), F.col("r_regionkey").alias("file")).write.partitionBy("file").text(at)
    found = text.settings(spark, at, ["name", "metric", "ef"])
    return found.select(F.regexp_replace("name", "_", " ").alias("r_name"), "metric", F.col("ef").cast("int").alias("ef"))


@query("SELECT o_orderkey::INTEGER % 1000 AS list_size, count(*) AS n, round(sum(o_totalprice), 2) AS qps FROM orders GROUP BY 1")
def log_scan(spark, sf_dir):
    """Rows of a benchmark log among other lines."""
    at = folder(spark)
    row = F.concat_ws("  ", (F.col("o_orderkey") % 1000).cast("string"), F.lit("0.5"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("9.9e-1"))
    table(spark, sf_dir, "orders").select(F.explode(F.array(F.lit("== run =="), row, F.lit("1 2 3"))).alias("value")).write.text(at)
    return text.log_rows(spark.read.text(at)).groupBy("list_size").agg(F.count("*").alias("n"), F.round(F.sum("qps"), 2).alias("qps"))


@query("SELECT CASE WHEN l_returnflag = 'N' THEN 'LD' ELSE 'ST' END AS op, l_partkey * 64 AS addr, count(*) AS n FROM lineitem GROUP BY 1, 2")
def load_store_scan(spark, sf_dir):
    """A trace of loads and stores with hexadecimal addresses."""
    at = folder(spark)
    line = F.concat(F.when(F.col("l_returnflag") == "N", "LD").otherwise("ST"), F.lit(" 0x"), F.hex(F.col("l_partkey") * 64))
    table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(at)
    return text.load_store_trace(spark.read.text(at)).groupBy("op", "addr").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_returnflag = 'N' THEN 'R' ELSE 'W' END AS op, l_linenumber AS bank, count(*) AS n FROM lineitem GROUP BY 1, 2")
def read_write_scan(spark, sf_dir):
    """A trace of reads and writes with address vectors."""
    at = folder(spark)
    line = F.concat(F.when(F.col("l_returnflag") == "N", "R").otherwise("W"), F.lit(" 0,"), "l_linenumber", F.lit(","), "l_partkey")
    table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(at)
    return text.read_write_trace(spark.read.text(at)).groupBy("op", F.col("addr_vec")[1].alias("bank")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, greatest((SELECT count(*) FROM events) - 500, 0) AS dropped FROM events ORDER BY ts, event_id LIMIT 500")
def capped_trace_sink(spark, sf_dir):
    """The first 500 accesses written to a trace, and how many it had no room for."""
    at = folder(spark)
    kept, dropped = text.capped(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["ts", "event_id"], 500)
    kept.drop("ts").write.csv(at, header=True)
    return text.delimited(spark, at, "event_id long, user_id long", ",").crossJoin(F.broadcast(dropped))  # one row


@query("SELECT l_suppkey % 4 AS channel, l_linestatus AS command, count(*) AS n FROM lineitem GROUP BY 1, 2")
def command_counter_sink(spark, sf_dir):
    """Counts of each channel's commands, one file a channel."""
    at = folder(spark)
    counts = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("channel"), F.col("l_linestatus").alias("command")).agg(F.count("*").alias("n"))
    counts.write.partitionBy("channel").csv(at, header=True)
    back = spark.read.option("header", True).schema("command string, n long, channel long").csv(at)
    return back.select("channel", "command", "n")


PARTS_SQL = "SELECT '| ' || p_partkey || ' | ' || p_name || ' | ' || p_size || ' |' AS value, row_number() OVER (ORDER BY p_name, p_partkey) + 1 AS line FROM part"


@query(f"SELECT 0::BIGINT AS line, '| p_partkey | p_name | p_size |' AS value UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT line, value FROM ({PARTS_SQL})")
def markdown_sink(spark, sf_dir):
    """All parts as a Markdown table, written as text and read back in order."""
    at = folder(spark)
    text.write_markdown(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), ["p_name", "p_partkey"], at)
    lines = spark.read.text(at).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    return sampling.positions(lines, ["file", "start", "n"], [], "line").select("line", "value")


_EVERY = "SELECT vec_id AS id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings"
BUNDLED = " UNION ALL ".join(
    f"SELECT '{name}' AS file, dense_rank() OVER (ORDER BY id) - 1 AS place, i::INTEGER AS i, round(x::DOUBLE, 6) AS x FROM ({rows})"
    for name, rows in {"base": _EVERY, "queries": f"{_EVERY} WHERE vec_id % 25 = 0", "truth": f"SELECT qid AS id, rank - 1 AS i, vec_id AS x FROM ({s.topk(s.all_pairs('fp32'), K)})"}.items()
)


@query(BUNDLED)
def bundle_roundtrip(spark, sf_dir):
    """Base, queries and ground truth written as one bundle, and every number of its files."""
    files.register(spark)
    at, base = folder(spark), vectors(spark, sf_dir)
    files.write_bundle(base, asked(base), search.knn(base, asked(base), K), at)
    back = None
    for name, layout in files.BUNDLE.items():
        rows = spark.read.format("vectors").option("layout", layout).load(f"{at}/{name}")
        column = "embedding" if layout in files.FLOATS else "neighbors"
        rows = rows.select(F.lit(name).alias("file"), F.col("vec_id").alias("place"), F.posexplode(column).alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))
        back = rows if back is None else back.unionByName(rows)
    return back


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {r}::BIGINT, {d}, '{m}')" for n, r, d, m in catalogue.DATASETS) + ") v(name, rows, dim, metric)")
def dataset_catalogue(spark, sf_dir):
    return catalogue.table(spark)


# Evaluation


ORDER = ["MACHINERY", "AUTOMOBILE", "BUILDING"]


@query("SELECT c_mktsegment AS dataset, n, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_mktsegment)::INTEGER AS place FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def custom_order(spark, sf_dir):
    """Groups in a given order, the others behind by name."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("dataset")).agg(F.count("*").alias("n"))
    return a.placed(n, "dataset", ORDER)


GRID = [round(0.44 + 0.002 * i, 3) for i in range(61)]
AT_GRID = (
    f"SELECT dataset, t AS target, pow(10.0, log10(qps) + CASE WHEN r1 IS NULL THEN 0 ELSE (t - recall) / (r1 - recall) END * (log10(coalesce(q1, qps)) - log10(qps))) AS qps_at FROM "
    f"(SELECT *, lead(recall) OVER (PARTITION BY dataset ORDER BY recall) AS r1, lead(qps) OVER (PARTITION BY dataset ORDER BY recall) AS q1 FROM ({FRONTIER})) f, "
    f"(SELECT unnest({GRID})::DOUBLE AS t) v WHERE recall <= t AND (t < r1 OR (r1 IS NULL AND t = recall))"
)


@query(
    f"WITH g AS ({AT_GRID}), p AS (SELECT x.dataset AS a, y.dataset AS b, x.target, x.qps_at > y.qps_at AS better, round(x.target * 1000)::BIGINT AS k FROM g x JOIN g y ON x.target = y.target AND x.dataset <> y.dataset), "
    "i AS (SELECT *, k - 2 * row_number() OVER (PARTITION BY a, b ORDER BY k) AS island FROM p WHERE better) SELECT a, b, min(target) AS low, max(target) AS high FROM i GROUP BY a, b, island"
)
def frontier_better(spark, sf_dir):
    """Ranges of recall, in steps of 0.002, over which one frontier beats another."""
    front = a.pareto_frontier(points(spark, sf_dir), ["dataset"], "recall", "qps", "point")
    grid = F.broadcast(spark.createDataFrame([(x,) for x in GRID], "target double"))  # as many rows as steps
    return a.better_ranges(a.frontier_interpolate(front, ["dataset"], "recall", "qps", grid), "dataset", 0.002)


@query(f"SELECT count(*) * 5 AS compared, sum(hits)::BIGINT AS hits, round(sum(hits) / (count(*) * 5), 6) AS recall FROM (SELECT qid, count(f.vec_id) AS hits FROM (SELECT qid, vec_id FROM ({s.topk(s.all_pairs('fp32'), 5)})) t LEFT JOIN (SELECT qid, vec_id FROM ({s.topk(s.all_pairs('int8'), K)})) f USING (qid, vec_id) GROUP BY qid)")
def recall_short_truth(spark, sf_dir):
    """Recall of ten results against a truth of five: the smaller count is compared."""
    base = vectors(spark, sf_dir)
    return a.rounded(search.recall_against(search.knn(base, asked(base), K, "int8"), search.knn(base, asked(base), 5), K, 5), "recall")


@query("SELECT n AS position, vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings WHERE vec_id % 40 = 0) WHERE n < 7")
def first_queries(spark, sf_dir):
    """The first seven rows of the query table."""
    return sampling.first_queries(vectors(spark, sf_dir).where("vec_id % 40 = 0"), "vec_id", 7).select("position", "vec_id")


@query(
    "WITH q AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id FROM embeddings WHERE vec_id % 100 <> 0), "
    "f AS (SELECT vec_id FROM b ORDER BY md5(vec_id || ':3'), vec_id LIMIT greatest(30 - (SELECT count(*) FROM q), 0)), o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 + (SELECT count(*) FROM q) AS position FROM f) "
    "SELECT position, vec_id, false AS from_base FROM q WHERE position < 30 UNION ALL SELECT position, vec_id, true FROM o"
)
def mixed_queries(spark, sf_dir):
    """Thirty queries: the query table's rows, filled up by a seeded sample of base rows."""
    v = vectors(spark, sf_dir)
    return sampling.mixed_queries(v.where("vec_id % 100 = 0"), v.where("vec_id % 100 <> 0"), "vec_id", 30, 3).select("position", "vec_id", "from_base")


BOUND = f"SELECT qid, vec_id, greatest(0, sum(q * q) + sum(v * v) + 2 * sum(t)) AS lb, sum((q - v) * (q - v)) AS d, sum(CASE WHEN i < 16 THEN (q - v) * (q - v) ELSE 0 END) AS part FROM ({COARSE}) GROUP BY qid, vec_id"
FIRST, SECOND = 1.1, 1.7


@query(f"SELECT qid, count(*) AS pairs, count(*) FILTER (lb > {FIRST}) AS pruned_first, count(*) FILTER (lb <= {FIRST} AND part > {SECOND}) AS pruned_midway, count(*) FILTER (lb <= {FIRST} AND part <= {SECOND} AND d > {SECOND}) AS pruned_second, count(*) FILTER (lb <= {FIRST} AND d <= {SECOND}) AS kept FROM ({BOUND}) GROUP BY qid")
def two_phase_prune(spark, sf_dir):
    """Pairs that signs and exponents prune, those that their exact terms prune after 16 dimensions or at the end, and those that stay."""
    base = vectors(spark, sf_dir)

    def stages(lb, d, part):
        first, midway, second = lb > FIRST, part > SECOND, d > SECOND
        found = [first, ~first & midway, ~first & ~midway & second, ~first & ~second]
        return [np.full(len(d), d.shape[1]), *(x.sum(axis=1) for x in found)]

    names = ["pairs", "pruned_first", "pruned_midway", "pruned_second", "kept"]
    p = search.counted(base, asked(base, EVERY), ["l2", "fp32", "head16"], stages, ", ".join(f"{n} long" for n in names))
    return p.groupBy("qid").agg(*[F.sum(n).alias(n) for n in names])


@query(f"SELECT count(*) AS calls, count(*) FILTER (lb > {FIRST}) AS first_level, count(*) FILTER (part > {FIRST}) AS second_level, count(*) FILTER (lb > {FIRST} OR part > {FIRST}) AS either FROM ({BOUND})")
def early_termination_counts(spark, sf_dir):
    """How often either level's bound would have ended a distance early; none does."""
    base, names = vectors(spark, sf_dir), ["calls", "first_level", "second_level", "either"]
    count = lambda lb, part: [np.full(len(lb), lb.shape[1]), *(x.sum(axis=1) for x in (lb > FIRST, part > FIRST, (lb > FIRST) | (part > FIRST)))]
    p = search.counted(base, asked(base, EVERY), ["l2", "head16"], count, ", ".join(f"{n} long" for n in names))
    return p.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


STEPS = [0, 16, 32, 64]


@query(
    "SELECT qid, step, count(*) AS pairs, count(*) FILTER (b > 1.1) AS pruned, round(min(b), 6) AS least, round(max(b), 6) AS most FROM ("
    + " UNION ALL ".join(f"SELECT qid, vec_id, {n} AS step, sum(CASE WHEN i < {n} THEN (q - v) * (q - v) ELSE q * q + v * v + 2 * t END) + 1e-9 AS b FROM ({COARSE}) GROUP BY qid, vec_id" for n in STEPS)
    + ") GROUP BY qid, step"
)
def stepwise_refinement(spark, sf_dir):
    """Bounds after 0, 16, 32 and 64 exact dimensions, and how many pairs each of them prunes."""
    base = vectors(spark, sf_dir)
    each = lambda b: [b.min(axis=1), b.max(axis=1), (b + 1e-9 > 1.1).sum(axis=1)]
    c = search.counted(base, asked(base, EVERY), STEPS, lambda *b: [np.full(len(b[0]), b[0].shape[1]), *(x for s in b for x in each(s))], "pairs long, " + ", ".join(f"least{n} double, most{n} double, pruned{n} long" for n in STEPS))
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("step"), "pairs", F.col(f"least{n}").alias("least"), F.col(f"most{n}").alias("most"), F.col(f"pruned{n}").alias("pruned")) for n in STEPS]))
    c = c.select("qid", steps.alias("s")).select("qid", "s.*").groupBy("qid", "step")
    return c.agg(F.sum("pairs").alias("pairs"), F.sum("pruned").alias("pruned"), F.round(F.min("least") + 1e-9, 6).alias("least"), F.round(F.max("most") + 1e-9, 6).alias("most"))


@query(
    "SELECT qid, seen, round(max(d) FILTER (k = 10 AND seen >= 50), 6) + 0.0 AS limit_d FROM (SELECT *, row_number() OVER (PARTITION BY qid, seen ORDER BY d, vec_id) AS k FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY vec_id) AS n FROM ({s.all_pairs('fp32')})) p, (VALUES (50), (100), (200)) v(seen) WHERE n <= seen) WHERE k <= 10 GROUP BY qid, seen"
)
def warm_thresholds(spark, sf_dir):
    """The tenth nearest among the first 50, 100 and 200 rows: a search's threshold as it goes on."""
    base = vectors(spark, sf_dir)
    d = search.pair_distances(search.leading(base, 200), asked(base), ["fp32"])
    return search.thresholds(d, "vec_id", "d0", 10, 50, [50, 100, 200]).select("qid", "seen", (F.round("limit", 6) + 0.0).alias("limit_d"))


@query("SELECT c_custkey, n_name AS nation, length(n_name) AS letters FROM customer JOIN nation ON c_nationkey = n_nationkey")
def map_lookup(spark, sf_dir):
    """A small table as a map, looked up without a join."""
    names = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("names"))
    c = table(spark, sf_dir, "customer").crossJoin(F.broadcast(names))  # one row
    return c.select("c_custkey", F.element_at("names", F.col("c_nationkey").cast("int")).alias("nation")).withColumn("letters", F.length("nation").cast("long"))



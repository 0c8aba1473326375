"""Benchmark-analytics queries on the star schema.

Datasets are market segments, designs are order priorities, throughput is
their summed order value; areas, components and recalls come from parts and
line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analytics as a
from ..sources.scratch import folder

QUERIES, ORACLES = {}, {}
CPU = "1-URGENT"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def matrix(spark, sf_dir) -> DataFrame:
    """dataset, design, qps."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    m = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("design"))
    return m.agg(F.round(F.sum("o_totalprice"), 2).alias("qps"))


MATRIX = "SELECT c_mktsegment AS dataset, o_orderpriority AS design, round(sum(o_totalprice), 2) AS qps FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
RATIOS = f"SELECT m.dataset, m.design, m.qps, b.qps AS base, m.qps / b.qps AS ratio FROM ({MATRIX}) m JOIN ({MATRIX}) b ON m.dataset = b.dataset AND b.design = '{CPU}'"


def ratios(spark, sf_dir) -> DataFrame:
    return a.baseline_normalize(matrix(spark, sf_dir), ["dataset"], "design", "qps", CPU)


@query(f"SELECT dataset, design, round(ratio, 6) AS ratio FROM ({RATIOS})")
def baseline_normalize(spark, sf_dir):
    return rounded(ratios(spark, sf_dir).select("dataset", "design", "ratio"), "ratio")


@query(f"SELECT design, round(exp(avg(ln(ratio))), 6) AS geomean FROM ({RATIOS}) GROUP BY design")
def geomean_speedup(spark, sf_dir):
    return rounded(ratios(spark, sf_dir).groupBy("design").agg(a.geomean(F.col("ratio")).alias("geomean")), "geomean")


@query(f"SELECT design, round(sum(qps) / sum(base), 6) AS ratio_of_sums, round(1 - sum(qps) / sum(base), 6) AS reduction FROM ({RATIOS}) GROUP BY design")
def ratio_of_sums(spark, sf_dir):
    r = ratios(spark, sf_dir).groupBy("design").agg((F.sum("qps") / F.sum("base")).alias("ratio_of_sums"))
    return rounded(r.withColumn("reduction", 1 - F.col("ratio_of_sums")), "ratio_of_sums", "reduction")


@query(f"SELECT design, round(avg(1 - ratio), 6) AS reduction FROM ({RATIOS}) GROUP BY design")
def mean_reduction(spark, sf_dir):
    return rounded(ratios(spark, sf_dir).groupBy("design").agg(F.avg(1 - F.col("ratio")).alias("reduction")), "reduction")


@query(f"SELECT design, round(min(ratio), 6) AS least, arg_min(dataset, (ratio, dataset)) AS at_least, round(max(ratio), 6) AS most, arg_max(dataset, (ratio, dataset)) AS at_most FROM ({RATIOS}) GROUP BY design")
def argmin_argmax(spark, sf_dir):
    return rounded(a.argmin_argmax(ratios(spark, sf_dir), ["design"], "ratio", "dataset"), "least", "most")


TRIALS = "SELECT l_returnflag AS dataset, l_linestatus AS metric, l_linenumber AS ef, l_extendedprice AS qps, l_orderkey AS trial FROM lineitem"


def trials(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("metric"), F.col("l_linenumber").alias("ef"), F.col("l_extendedprice").alias("qps"), F.col("l_orderkey").alias("trial"))


@query(f"SELECT dataset, metric, ef, round(median(qps), 4) AS median, round(avg(qps), 4) AS mean, round(coalesce(stddev_samp(qps), 0), 4) AS stdev, min(qps) AS least, max(qps) AS most, count(*) AS n FROM ({TRIALS}) GROUP BY dataset, metric, ef")
def trial_summary(spark, sf_dir):
    t = a.trial_summary(trials(spark, sf_dir), ["dataset", "metric", "ef"], "qps")
    return t.withColumns({c: F.round(c, 4) for c in ("median", "mean", "stdev")})


@query("SELECT o_custkey, median, n FROM (SELECT o_custkey, round(median(o_totalprice), 4) AS median, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k > 1 GROUP BY o_custkey)")
def warm_median(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return a.warm_median(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").withColumn("median", F.round("median", 4))


# A supplier's recall is its mean discount, its qps its summed quantity.
POINTS = "SELECT s_nationkey AS dataset, s_suppkey AS point, round(avg(l_discount) * 10, 6) AS recall, round(sum(l_quantity), 2) AS qps FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"


def points(spark, sf_dir) -> DataFrame:
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dataset"))
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("point")).agg(F.round(F.avg("l_discount") * 10, 6).alias("recall"), F.round(F.sum("l_quantity"), 2).alias("qps"))
    return one.join(sup, F.col("point") == F.col("s_suppkey")).select("dataset", "point", "recall", "qps")


LEVELS = [0.48, 0.5, 0.52]


@query(f"SELECT dataset, t AS threshold, min(recall) AS recall, arg_min(qps, (recall, -qps)) AS qps FROM ({POINTS}) p, (VALUES (0.48::DOUBLE), (0.5), (0.52)) v(t) WHERE recall >= t GROUP BY dataset, t")
def best_qps_at_recall(spark, sf_dir):
    return a.best_at(points(spark, sf_dir), ["dataset"], "recall", "qps", LEVELS)


FRONTIER = f"SELECT dataset, point, recall, qps, row_number() OVER (PARTITION BY dataset ORDER BY recall) AS frontier_rank FROM (SELECT *, max(qps) OVER (PARTITION BY dataset ORDER BY recall DESC, qps DESC, point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ({POINTS})) WHERE best IS NULL OR qps > best"


@query(f"SELECT dataset, point, recall, qps, frontier_rank::INTEGER AS frontier_rank FROM ({FRONTIER})")
def pareto_frontier(spark, sf_dir):
    return a.pareto_frontier(points(spark, sf_dir), ["dataset"], "recall", "qps", "point")


@query(
    f"SELECT dataset, t AS target, round(pow(10.0, log10(qps) + CASE WHEN r1 IS NULL THEN 0 ELSE (t - recall) / (r1 - recall) END * (log10(coalesce(q1, qps)) - log10(qps))), 4) AS qps_at FROM "
    f"(SELECT *, lead(recall) OVER (PARTITION BY dataset ORDER BY recall) AS r1, lead(qps) OVER (PARTITION BY dataset ORDER BY recall) AS q1 FROM ({FRONTIER})) f, (VALUES (0.49::DOUBLE), (0.5), (0.51)) v(t) WHERE recall <= t AND (t < r1 OR (r1 IS NULL AND t = recall))"
)
def frontier_interpolate(spark, sf_dir):
    front = a.pareto_frontier(points(spark, sf_dir), ["dataset"], "recall", "qps", "point")
    targets = F.broadcast(spark.createDataFrame([(x,) for x in (0.49, 0.5, 0.51)], "target double"))
    return a.frontier_interpolate(front, ["dataset"], "recall", "qps", targets).withColumn("qps_at", F.round("qps_at", 4))


@query("SELECT c_mktsegment AS dataset, count(*) FILTER (o_orderstatus = 'F') AS pass, count(*) FILTER (o_orderstatus = 'O') AS fail, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def status_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("dataset"))
    p = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("dataset").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("dataset", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(n) for x, n in (("F", "pass"), ("O", "fail"), ("P", "pending"))])


@query("SELECT design, component, round(area / sum(area) OVER (PARTITION BY design), 6) AS share, round(area / max(area) OVER (), 6) AS norm FROM (SELECT p_brand AS design, p_type AS component, round(sum(p_retailprice), 2) AS area FROM part GROUP BY 1, 2)")
def component_shares(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("design"), F.col("p_type").alias("component")).agg(F.round(F.sum("p_retailprice"), 2).alias("area"))
    most = p.agg(F.max("area").alias("most"))
    p = p.withColumn("share", F.col("area") / F.sum("area").over(Window.partitionBy("design")))
    return rounded(p.crossJoin(F.broadcast(most)).select("design", "component", "share", (F.col("area") / F.col("most")).alias("norm")), "share", "norm")


@query(
    "SELECT n_regionkey AS file, 0::BIGINT AS section, 'area' AS metric, n_name AS component, d AS design, (n_nationkey * f)::DOUBLE AS value FROM nation, (VALUES ('A', 1.0), ('B', 2.5)) t(d, f) "
    "UNION ALL SELECT n_regionkey, 1, 'power', n_name, 'A', n_nationkey + 0.5::DOUBLE FROM nation"
)
def sectioned_melt(spark, sf_dir):
    """Sectioned files, one a region, written and melted."""
    n = table(spark, sf_dir, "nation")
    rows = lambda *cells: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))), lambda x: F.concat_ws("\t", x["n_name"], *[c(x["n_nationkey"]) for c in cells])), "\n")
    area, power = rows(lambda k: (k * 1.0).cast("string"), lambda k: (k * 2.5).cast("string")), rows(lambda k: (k + 0.5).cast("string"))
    text = F.concat(F.lit("area\tA\tB\n"), area, F.lit("\n\npower\tA\n"), power, F.lit("\n\n"))
    at = folder(spark)
    n.groupBy(F.col("n_regionkey").alias("region")).agg(text.alias("value")).write.partitionBy("region").text(at)
    return a.sectioned_melt(spark.read.text(at, wholetext=True), "region", "value").withColumnRenamed("region", "file")


# Energy and area


def runs(spark, sf_dir) -> DataFrame:
    """Operation counts and memory energy of each (dataset, design) of the line items."""
    line = table(spark, sf_dir, "lineitem")
    model = F.element_at(F.array(*[F.lit(m) for m in ("std_fp", "fpma", "fpsa", "base_et", "fpsa_et")]), F.pmod(F.col("l_linenumber") - 1, F.lit(5)) + 1)
    return line.groupBy(F.col("l_returnflag").alias("dataset"), model.alias("model")).agg(
        F.round(F.sum("l_quantity"), 2).alias("ops"), F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 2).alias("phase1"), F.round(F.sum(F.col("l_quantity") * F.col("l_tax")), 2).alias("phase2"),
        F.round(F.sum("l_extendedprice") / 1000, 2).alias("memory_nj"), F.count("*").cast("double").alias("qps"),
    )


RUNS = "SELECT l_returnflag AS dataset, ['std_fp', 'fpma', 'fpsa', 'base_et', 'fpsa_et'][(l_linenumber - 1) % 5 + 1] AS model, round(sum(l_quantity), 2) AS ops, round(sum(l_quantity * l_discount), 2) AS phase1, round(sum(l_quantity * l_tax), 2) AS phase2, round(sum(l_extendedprice) / 1000, 2) AS memory_nj, count(*)::DOUBLE AS qps FROM lineitem GROUP BY 1, 2"
ENERGY = f"SELECT *, compute_nj + memory_nj AS total_nj, (compute_nj + memory_nj) * qps / 1e12 AS power_w, 1e12 / (compute_nj + memory_nj) AS qps_per_w FROM (SELECT *, CASE model WHEN 'std_fp' THEN ops * 1.7 WHEN 'fpma' THEN ops * 0.6 WHEN 'fpsa' THEN ops * 0.46 WHEN 'base_et' THEN (phase1 + phase2) * 1.7 ELSE phase1 * 2 * 0.06 + phase2 * 0.28 END::DOUBLE / 1000 AS compute_nj FROM ({RUNS}))"


@query(f"SELECT dataset, model, round(compute_nj, 6) AS compute_nj, round(total_nj, 4) AS total_nj, round(power_w * 1e9, 4) AS power_nw, round(qps_per_w, 0) AS qps_per_w FROM ({ENERGY})")
def energy_model(spark, sf_dir):
    e = a.energy_rows(runs(spark, sf_dir))
    return e.select("dataset", "model", F.round("compute_nj", 6).alias("compute_nj"), F.round("total_nj", 4).alias("total_nj"), F.round(F.col("power_w") * 1e9, 4).alias("power_nw"), F.round("qps_per_w", 0).alias("qps_per_w"))


@query(f"SELECT dataset, model, round(qps_per_w, 0) AS qps_per_w, NULL::VARCHAR AS source FROM ({ENERGY}) UNION ALL SELECT l_returnflag, 'external', round(count(*) / 300.0, 0), 'measured' FROM lineitem GROUP BY l_returnflag")
def energy_union(spark, sf_dir):
    """Modelled rows and externally measured ones, which bring a source and no energies."""
    e = a.energy_rows(runs(spark, sf_dir)).select("dataset", "model", F.round("qps_per_w", 0).alias("qps_per_w"))
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset")).agg(F.round(F.count("*") / 300.0, 0).alias("qps_per_w"))
    return e.unionByName(x.withColumn("model", F.lit("external")).withColumn("source", F.lit("measured")), allowMissingColumns=True)


@query(f"SELECT m.dataset, m.design, round(e, 6) AS kqps_per_mm2, round(e / max(e) FILTER (m.design = '{CPU}') OVER (PARTITION BY m.dataset), 6) AS ratio FROM (SELECT m.*, qps / 1000 / area AS e FROM ({MATRIX}) m JOIN (SELECT o_orderpriority AS design, (10 + row_number() OVER (ORDER BY o_orderpriority))::DOUBLE AS area FROM (SELECT DISTINCT o_orderpriority FROM orders)) USING (design)) m")
def area_efficiency(spark, sf_dir):
    designs = matrix(spark, sf_dir).select("design").distinct()  # a handful
    areas = designs.withColumn("area_mm2", (10 + F.row_number().over(Window.orderBy("design"))).cast("double"))
    return rounded(a.area_efficiency(matrix(spark, sf_dir), areas, "design", ["dataset"], CPU).select("dataset", "design", "kqps_per_mm2", "ratio"), "kqps_per_mm2", "ratio")


LATENCY = "SELECT l_orderkey, l_linenumber, l_extendedprice AS total, l_extendedprice * l_discount AS index, l_extendedprice * l_tax AS gather, l_quantity AS raw, l_quantity * l_discount AS hidden FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, round(index, 6) AS index, round(gather, 6) AS gather, round(d * hidden / raw, 6) AS hidden_part, round(d - d * hidden / raw, 6) AS visible_part FROM (SELECT *, total - index - gather AS d FROM ({LATENCY}))")
def latency_breakdown(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    price, n = F.col("l_extendedprice"), F.col("l_quantity")
    rows = line.select("l_orderkey", "l_linenumber", price.alias("total"), (price * F.col("l_discount")).alias("index"), (price * F.col("l_tax")).alias("gather"), n.alias("raw"), (n * F.col("l_discount")).alias("hidden"))
    s = a.latency_segments(rows).select("l_orderkey", "l_linenumber", "index", "gather", "hidden_part", "visible_part")
    return rounded(s, "index", "gather", "hidden_part", "visible_part")


@query("SELECT o_orderkey, round(1000 * 2.4e9 / (o_totalprice * 1000), 4) AS qps FROM orders WHERE o_totalprice > 0")
def qps_from_cycles(spark, sf_dir):
    """Queries a second of 1,000 queries at 2.4 GHz."""
    return table(spark, sf_dir, "orders").where("o_totalprice > 0").select("o_orderkey", F.round(F.lit(1000) * 2.4e9 / (F.col("o_totalprice") * 1000), 4).alias("qps"))


@query(f"SELECT dataset, design, round(qps / max(qps) OVER (PARTITION BY dataset), 6) AS in_group, round(qps / max(qps) OVER (), 6) AS overall FROM ({MATRIX})")
def norm_to_max(spark, sf_dir):
    m = matrix(spark, sf_dir)
    top = m.agg(F.max("qps").alias("top"))
    return rounded(m.crossJoin(F.broadcast(top)).select("dataset", "design", (F.col("qps") / F.max("qps").over(Window.partitionBy("dataset"))).alias("in_group"), (F.col("qps") / F.col("top")).alias("overall")), "in_group", "overall")


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice / 104999)::DECIMAL(18,6), 2)::DOUBLE AS recall_2dp FROM lineitem")
def recall_rounding(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.round_half_up(F.col("l_extendedprice") / 104999, 2).cast("double").alias("recall_2dp"))


# Constraints: violations


@query("WITH g AS (SELECT DISTINCT o_orderpriority AS design, o_orderdate::DATE AS day FROM orders) SELECT design, day::VARCHAR AS day, prev::VARCHAR AS previous FROM (SELECT *, lag(day) OVER (PARTITION BY design ORDER BY day) AS prev FROM g) WHERE day - prev > 1")
def grid_gaps(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("design"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01")).alias("n"))
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c)).cast("string")
    return a.grid_gaps(g, ["design"], "n", 1).select("design", day("n").alias("day"), day("previous").alias("previous"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return a.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH h AS (SELECT DISTINCT lang, source FROM documents WHERE doc_id % 7 = 0), s AS (SELECT l.lang, r.source FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents WHERE source <> 'src3') r) SELECT *, 'missing' AS problem FROM (SELECT * FROM s EXCEPT SELECT * FROM h) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM h EXCEPT SELECT * FROM s)")
def matrix_gaps(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return a.matrix_gaps(d.where("doc_id % 7 = 0"), d.select("lang").distinct(), d.where("source <> 'src3'").select("source").distinct())


@query("SELECT c_mktsegment AS dataset, count(DISTINCT o_orderstatus) AS baselines FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def baseline_consistency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == CPU).select("o_custkey", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("dataset"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("dataset").agg(F.countDistinct("o_orderstatus").alias("baselines")).where("baselines > 1")


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, 'left' AS side FROM (SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey + (o_orderkey % 50 = 0)::INT FROM orders) UNION ALL SELECT o_orderkey, c, 'right' FROM (SELECT o_orderkey, o_custkey + (o_orderkey % 50 = 0)::INT AS c FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders))")
def copy_equals_source(spark, sf_dir):
    """A derived copy against its source: rows that one has and the other lacks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    copy = o.select("o_orderkey", (F.col("o_custkey") + (F.col("o_orderkey") % 50 == 0).cast("int")).alias("o_custkey"))
    return a.differences(o, copy)


@query("SELECT x.l_orderkey, x.l_suppkey = y.l_suppkey AS same_supplier, x.l_extendedprice < y.l_extendedprice AS ordered FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2 WHERE NOT (x.l_suppkey = y.l_suppkey AND x.l_extendedprice < y.l_extendedprice)")
def pair_invariants(spark, sf_dir):
    """Pairs of runs that should share their setting and be strictly ordered: one pass instead of a self-join."""
    line = table(spark, sf_dir, "lineitem").where("l_linenumber in (1, 2)")
    g = line.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("p"))).alias("rows"))
    pairs = g.select("l_orderkey", F.explode(F.expr("filter(rows, r -> r.n = 1)")).alias("x"), "rows").select("l_orderkey", "x", F.explode(F.expr("filter(rows, r -> r.n = 2)")).alias("y"))
    out = pairs.select("l_orderkey", (F.col("x.s") == F.col("y.s")).alias("same_supplier"), (F.col("x.p") < F.col("y.p")).alias("ordered"))
    return out.where(~(F.col("same_supplier") & F.col("ordered")))


@query(f"SELECT dataset, point, recall, qps FROM ({POINTS}) WHERE NOT (recall > 0.895 AND isfinite(qps) AND qps > 0)")
def recall_gate(spark, sf_dir):
    ok = (F.col("recall") > 0.895) & ~F.isnan("qps") & (F.col("qps") < float("inf")) & (F.col("qps") > 0)
    return points(spark, sf_dir).where(~ok)


@query("SELECT o_orderkey, o_totalprice AS exported, round(s, 2) AS recomputed FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE NOT abs(o_totalprice - s) <= 7e-4 * greatest(abs(o_totalprice), abs(s))")
def constraint_violations(spark, sf_dir):
    """Exported values that differ from what their parts give."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    bad = o.join(s, F.col("o_orderkey") == F.col("l_orderkey")).where(~a.is_close(F.col("o_totalprice"), F.col("s"), rel=7e-4))
    return bad.select("o_orderkey", F.col("o_totalprice").alias("exported"), F.round("s", 2).alias("recomputed"))


@query("SELECT event_id, event_type AS field, k AS found FROM (SELECT event_id, event_type, regexp_extract(props, '\"k\":\\s*(-?\\d+)', 1) AS k FROM events) WHERE event_type = 'click' AND k <> '3'")
def config_mismatch(spark, sf_dir):
    """Key-value settings against the values expected for their field."""
    expected = F.broadcast(spark.createDataFrame([("click", "3")], "field string, want string"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("field"), F.regexp_extract("props", r'"k":\s*(-?\d+)', 1).alias("found"))
    return e.join(expected, "field").where("found <> want").select("event_id", "field", "found")


@query("SELECT l_returnflag AS dataset, count(DISTINCT (l_linestatus, l_tax)) AS configs FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_linestatus, l_tax)) > 1")
def config_homogeneity(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset")).agg(F.countDistinct(F.struct("l_linestatus", "l_tax")).alias("configs"))
    return c.where("configs > 1")


@query("SELECT d.doc_id, sha256(text) = sha256(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) AS same_digest, NOT starts_with(source, '/') AS relative FROM documents d WHERE doc_id % 9 = 0")
def digest_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    listed = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("listed"))
    found = d.select("doc_id", F.sha2("text", 256).alias("digest"), (~F.col("source").startswith("/")).alias("relative"))
    j = found.join(listed, "doc_id").select("doc_id", (F.col("digest") == F.col("listed")).alias("same_digest"), "relative")
    return j.where(~(F.col("same_digest") & F.col("relative")))


# Joins and sets


@query(f"SELECT dataset, design, qps, n FROM ({MATRIX}) JOIN (SELECT c_mktsegment AS dataset, o_orderpriority AS design, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) USING (dataset, design)")
def metric_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("design"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("dataset"))
    n = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("dataset", "design").agg(F.count("*").alias("n"))
    return matrix(spark, sf_dir).join(n, ["dataset", "design"])


@query("SELECT p.p_partkey, min(q.p_partkey) AS match FROM part p JOIN part q ON p.p_retailprice::DECIMAL(18,2) = q.p_retailprice::DECIMAL(18,2) AND p.p_brand = q.p_brand AND p.p_partkey <> q.p_partkey GROUP BY p.p_partkey HAVING count(*) = 1")
def unique_match(spark, sf_dir):
    """Rows with exactly one partner of equal decimal value."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    g = p.groupBy("p_brand", "price").agg(F.count("*").alias("n"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi")).where("n = 2")
    return g.select(F.explode(F.array(F.struct(F.col("lo").alias("p_partkey"), F.col("hi").alias("match")), F.struct(F.col("hi").alias("p_partkey"), F.col("lo").alias("match")))).alias("m")).select("m.*")


@query("WITH a AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier), b AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) SELECT s_nationkey AS nation, n::INTEGER AS n, s_suppkey, c_custkey, abs(s_suppkey - c_custkey) <= 200 AS near FROM a JOIN b USING (n) WHERE s_nationkey = c_nationkey")
def zip_join(spark, sf_dir):
    """The n-th row of one side with the n-th of the other, and whether they agree within a tolerance."""
    left = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("n"))
    right = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("n"))
    return left.join(right, ["nation", "n"]).withColumn("near", F.abs(F.col("s_suppkey") - F.col("c_custkey")) <= 200)


@query("SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def set_difference(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id")
    return a.differences(d, table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT event_id, try_cast(regexp_extract(props, '\"k\":\\s*(-?\\d+)', 1) AS BIGINT) AS k FROM events")
def props_extract(spark, sf_dir):
    """The first match of a key's scalar."""
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", r'"k":\s*(-?\d+)', 1).try_cast("long").alias("k"))

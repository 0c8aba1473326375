"""Benchmark analytics: normalisation, means, summaries, frontiers and derived metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def baseline_normalize(df: DataFrame, keys: list[str], design: str, value: str, baseline: str) -> DataFrame:
    """Add ``base`` and ``ratio``: each row against its group's baseline row; no self-join."""
    base = F.max(F.when(F.col(design) == baseline, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("base", base).withColumn("ratio", F.col(value) / F.col("base"))


def geomean(x: Column) -> Column:
    """exp(mean(ln x)); a value that is not positive fails the query."""
    return F.exp(F.avg(F.when(x > 0, F.ln(x)).otherwise(F.raise_error(F.lit("the geometric mean needs positive values")).cast("double"))))


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


#: Distinct values of a group that one task orders.
RUN = 1 << 20


def placed_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, upto and total: each distinct value's count, that of all up to it in its group, and the group's.

    Values are counted first and dealt out in ranges, so no task holds a group.
    """
    order = [*keys, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*order).agg(F.count("*").alias("n"))
    distinct = counts.count()
    if distinct <= RUN:  # one task orders them all: no table is written, and a group is a window
        group = Window.partitionBy(*keys)
        upto = F.sum("n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return counts.select(*order, "n", upto.alias("upto"), F.sum("n").over(group).alias("total"))
    dealt = cut(cut(counts).repartitionByRange(-(-distinct // RUN), *order).withColumn("_part", F.spark_partition_id()))
    inside = F.sum("n").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))  # a row for RUN values, or for a group
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), before.alias("_before"), F.sum("_n").over(group).alias("total"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return dealt.withColumn("_in", inside).join(sums, same).select(*order, "n", (F.col("_in") + F.col("_before")).alias("upto"), "total")


def median_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median and n of the values that are not null."""
    v = placed_values(df, keys, value)
    half = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    at = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place), F.col(value)))
    return v.groupBy(*keys).agg(((at(half[0]) + at(half[1])) / 2).alias("median"), F.max("total").alias("n"))


def percentile_of(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each ``name: share``, the least value that so many of the group do not exceed."""
    v = placed_values(df, keys, value)
    return v.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") / F.col("total") >= share, F.col(value))).alias(name) for name, share in shares.items()])


def _with_median(totals: DataFrame, medians: DataFrame, keys: list[str]) -> DataFrame:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    m = medians.select(*[F.col(k).alias(f"_{k}") for k in keys], "median")
    return totals.join(m, same, "left")


def trial_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    rest = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(v).alias("n"))
    return _with_median(rest, median_of(df, keys, value), keys).select(*keys, "median", "mean", "stdev", "least", "most", "n")


def warm_median(df: DataFrame, keys: list[str], order: list[str], value: str, warmup: int = 1) -> DataFrame:
    """Median without each group's first ``warmup`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    warm = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > warmup)
    return _with_median(warm.groupBy(*keys).agg(F.count("*").alias("n")), median_of(warm, keys, value), keys).select(*keys, "median", "n")


def best_at(df: DataFrame, keys: list[str], recall: str, qps: str, thresholds: list[float]) -> DataFrame:
    """For each threshold, the point with the least recall that reaches it (ties: higher qps)."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds]))
    reached = df.withColumn("threshold", t).where(F.col(recall) >= F.col("threshold"))
    return reached.groupBy(*keys, "threshold").agg(F.min(F.struct(F.col(recall), (-F.col(qps)).alias("_q"))).alias("_m")).select(*keys, "threshold", F.col(f"_m.{recall}").alias(recall), (-F.col("_m._q")).alias(qps))


def pareto_frontier(df: DataFrame, keys: list[str], recall: str, qps: str, row: str) -> DataFrame:
    """Points that no point with as much recall beats in qps, numbered from low recall to high."""
    w = Window.partitionBy(*keys).orderBy(F.col(recall).desc(), F.col(qps).desc(), row)
    kept = df.withColumn("_best", F.max(qps).over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_best").isNull() | (F.col(qps) > F.col("_best")))
    return kept.drop("_best").withColumn("frontier_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(recall)))


def frontier_interpolate(frontier: DataFrame, keys: list[str], recall: str, qps: str, targets: DataFrame) -> DataFrame:
    """qps at each target recall, linear in log10(qps) between the frontier's neighbours; null outside it."""
    w = Window.partitionBy(*keys).orderBy(recall)
    s = frontier.withColumn("_r1", F.lead(recall).over(w)).withColumn("_q1", F.lead(qps).over(w))
    inside = (F.col(recall) <= F.col("target")) & ((F.col("target") < F.col("_r1")) | (F.col("_r1").isNull() & (F.col("target") == F.col(recall))))
    share = F.when(F.col("_r1").isNull(), F.lit(0.0)).otherwise((F.col("target") - F.col(recall)) / (F.col("_r1") - F.col(recall)))
    log = F.log10(qps) + share * (F.log10(F.coalesce("_q1", F.col(qps))) - F.log10(qps))
    return s.join(targets, inside).select(*keys, "target", F.pow(F.lit(10.0), log).alias("qps_at"))


def argmin_argmax(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    lo, hi = F.min(F.struct(value, name)), F.max(F.struct(F.col(value), F.col(name)))
    return df.groupBy(*keys).agg(lo.alias("_a"), hi.alias("_b")).select(*keys, F.col(f"_a.{value}").alias("least"), F.col(f"_a.{name}").alias("at_least"), F.col(f"_b.{value}").alias("most"), F.col(f"_b.{name}").alias("at_most"))


def round_half_up(x: Column, digits: int) -> Column:
    """Decimal rounding of a decimal; doubles are never rounded as they are."""
    return F.round(x.cast("decimal(18,6)"), digits).cast(f"decimal(18,{digits})")


# Energy of an operation, in picojoules, by compute model.
STD_FP, FPMA, FPSA, SIGN_EXPONENT, SECOND_PHASE = 1.7, 0.6, 0.46, 0.06, 0.28


def compute_energy(model: Column, ops: Column, phase1: Column, phase2: Column) -> Column:
    """Nanojoules of the compute units."""
    pj = (
        F.when(model == "std_fp", ops * STD_FP).when(model == "fpma", ops * FPMA).when(model == "fpsa", ops * FPSA)
        .when(model == "base_et", (phase1 + phase2) * STD_FP)
        .when(model == "fpsa_et", phase1 * 2 * SIGN_EXPONENT + phase2 * SECOND_PHASE)
    )
    return pj / 1000


def energy_rows(df: DataFrame) -> DataFrame:
    """df: model, ops, phase1, phase2, memory_nj, qps.  E is for 1,000 queries, so W = E * QPS / 1e12."""
    e = df.withColumn("compute_nj", compute_energy(F.col("model"), F.col("ops"), F.col("phase1"), F.col("phase2"))).withColumn("total_nj", F.col("compute_nj") + F.col("memory_nj"))
    return e.withColumn("power_w", F.col("total_nj") * F.col("qps") / 1e12).withColumn("qps_per_w", 1e12 / F.col("total_nj"))


def area_efficiency(df: DataFrame, areas: DataFrame, on: str, keys: list[str], baseline: str) -> DataFrame:
    e = df.join(areas, on).withColumn("kqps_per_mm2", F.col("qps") / 1000 / F.col("area_mm2"))
    return baseline_normalize(e, keys, on, "kqps_per_mm2", baseline)


def latency_segments(df: DataFrame) -> DataFrame:
    """df: total, index, gather, raw, hidden.  Distance time splits into what memory hides and what shows."""
    d = df.withColumn("distance", F.col("total") - F.col("index") - F.col("gather"))
    d = d.withColumn("hidden_part", F.when(F.col("raw") > 0, F.col("distance") * F.col("hidden") / F.col("raw")).otherwise(F.lit(0.0)))
    return d.withColumn("visible_part", F.col("distance") - F.col("hidden_part"))


# Constraints: queries that return violations.


#: Keys that a specification may have.
MOST_KEYS = 1_000_000


def matrix_gaps(df: DataFrame, *axes: DataFrame) -> DataFrame:
    """Missing and extra keys against the product of the axes; a specification of more than MOST_KEYS keys is an error."""
    sizes = [a.count() for a in axes]
    if math.prod(sizes) > MOST_KEYS:
        raise ValueError(f"a specification of {math.prod(sizes)} keys")
    spec = axes[0]
    for a in axes[1:]:
        spec = spec.crossJoin(F.broadcast(a))
    keys = spec.columns
    have = df.select(*keys).distinct()
    return spec.join(have, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(have.join(spec, keys, "left_anti").withColumn("problem", F.lit("extra")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one but not of the other, with multiplicity."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def grid_gaps(df: DataFrame, keys: list[str], value: str, step: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(value)
    return df.select(*keys, value).distinct().withColumn("previous", F.lag(value).over(w)).where(F.col(value) - F.col("previous") > step)


def sectioned_melt(files: DataFrame, file: str, text: str, sep: str = r"\t") -> DataFrame:
    """Long rows of sectioned tables, one file a row: a blank line ends a section, whose first row names the metric and the designs."""
    lines = files.select(F.col(file).alias("file"), F.posexplode(F.split(text, r"\r?\n")).alias("_at", "_line"))
    blank = F.trim("_line") == ""
    w = Window.partitionBy("file").orderBy("_at")
    s = lines.withColumn("section", F.sum(blank.cast("int")).over(w)).where(~blank).withColumn("cells", F.split("_line", sep))
    first = Window.partitionBy("file", "section").orderBy("_at")
    s = s.withColumn("head", F.first("cells").over(first)).withColumn("n", F.row_number().over(first)).where("n > 1")
    pairs = F.arrays_zip(F.expr("slice(head, 2, size(head))").alias("design"), F.expr("slice(cells, 2, size(cells))").alias("value"))
    melted = s.select("file", "section", F.col("head")[0].alias("metric"), F.col("cells")[0].alias("component"), F.explode(pairs).alias("p"))
    return melted.select("file", "section", "metric", "component", F.col("p.design").alias("design"), F.col("p.value").cast("double").alias("value"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


def placed(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Add place: the names of ``order`` first, as they stand there, then the others; few rows."""
    at = F.array_position(F.array(*[F.lit(n) for n in order]), F.col(name))
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.when(at == 0, len(order) + 1).otherwise(at), name)))


def better_ranges(at: DataFrame, key: str, step: float) -> DataFrame:
    """a, b, low, high: the runs of grid points (target, qps_at) at which a's value exceeds b's."""
    other = at.select(F.col(key).alias("b"), "target", F.col("qps_at").alias("_q"))
    better = at.select(F.col(key).alias("a"), "target", "qps_at").join(other, "target").where((F.col("a") != F.col("b")) & (F.col("qps_at") > F.col("_q")))
    island = F.round(F.col("target") / step) - F.row_number().over(Window.partitionBy("a", "b").orderBy("target"))
    return better.withColumn("_i", island).groupBy("a", "b", "_i").agg(F.min("target").alias("low"), F.max("target").alias("high")).drop("_i")


def staged(pairs: DataFrame, bound: str, first: float, part: str, d: str, second: float) -> DataFrame:
    """For each query, what a bound, a partial and a whole distance prune one after another."""
    coarse, midway = F.col(bound) > first, F.col(part) > second
    return pairs.groupBy("qid").agg(
        F.count("*").alias("pairs"), F.count_if(coarse).alias("pruned_first"), F.count_if(~coarse & midway).alias("pruned_midway"),
        F.count_if(~coarse & ~midway & (F.col(d) > second)).alias("pruned_second"), F.count_if(~coarse & (F.col(d) <= second)).alias("kept"),
    )

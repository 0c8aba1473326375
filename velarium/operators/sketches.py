"""Activity of epochs: exact, and from mergeable sketches that are kept as state.

A state table has a row for each epoch and batch: the rows counted, a
HyperLogLog sketch of who was active, a KLL sketch of the values and a
frequent-items sketch.  Batches append to it without reading the events of
others, and any set of its rows, of later batches or of longer epochs, merges
into one answer.  Merging is a grouped aggregation that combines before its
exchange; a row is a few KB, however many events it stands for.

Stated errors: distinct counts 1.04 / sqrt(2**LG) as standard deviation, ranks
of quantiles RANK (over twice what it is 99 % of the time).  Frequent items are
listed with counts that are never too low; items are only listed if they stand
out from the sketch's error, so a list is empty where nothing does, and then no
item has more than the share UNLISTED of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import percentile_of

LG, K, ITEMS = 12, 800, 512
#: Standard deviation of a distinct count, as a share of it; error of a quantile's rank.
SPREAD, RANK = 1.04 / (1 << LG) ** 0.5, 0.01
#: A count's error is at most 3.5 rows for each place of the sketch's table; an item that is not listed has at most twice that.
UNLISTED = 2 * 3.5 / (1 << math.ceil(math.log2(ITEMS / 0.75)))


def active(df: DataFrame, time: str, width: str, who: str) -> DataFrame:
    """epoch (its start) and active: the distinct ``who`` of each tumbling window, exactly."""
    return df.groupBy(F.window(time, width).alias("w")).agg(F.count_distinct(who).alias("active")).select(F.col("w.start").alias("epoch"), "active")


def over_epochs(counts: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """One row: epochs, mean, and the nearest-rank percentile of ``value``."""
    at = percentile_of(counts.withColumn("_all", F.lit(0)), ["_all"], value, {"percentile": share}).select(F.col("percentile").cast("double").alias("percentile"))
    return counts.agg(F.count(value).alias("epochs"), F.avg(value).alias("mean")).join(F.broadcast(at)).select("epochs", "mean", "percentile")  # one row each


def sketched(df: DataFrame, time: str, width: str, who: str, value: str) -> DataFrame:
    """A batch's state: epoch, n, who, values and items."""
    w = df.groupBy(F.window(time, width).alias("w"))
    state = w.agg(F.count("*").alias("n"), F.hll_sketch_agg(who, LG).alias("who"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("values"), F.expr(f"approx_top_k_accumulate({who}, {ITEMS})").alias("items"))
    return state.select(F.col("w.start").alias("epoch"), "n", "who", "values", "items")


def merged(state: DataFrame, epoch: Column | None = None) -> DataFrame:
    """The state of longer epochs (``epoch`` of the old one; all, without it), or of several batches, from their rows alone."""
    group = state.groupBy((F.lit("all") if epoch is None else epoch).alias("epoch"))
    return group.agg(F.sum("n").alias("n"), F.hll_union_agg("who").alias("who"), F.kll_merge_agg_double("values").alias("values"), F.expr(f"approx_top_k_combine(items, {ITEMS})").alias("items"))


def estimates(state: DataFrame, shares: list[float], top: int) -> DataFrame:
    """epoch, n, active, quantiles (of each share) and top (items with their counts, most frequent first; may be empty)."""
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("values", F.lit(s)) for s in shares])
    return state.select("epoch", "n", F.hll_sketch_estimate("who").alias("active"), quantiles.alias("quantiles"), F.expr(f"approx_top_k_estimate(items, {top})").alias("top"))

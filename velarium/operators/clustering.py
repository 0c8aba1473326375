"""Balanced clusters: seeds, rounds of means, and an assignment that no cluster overflows.

Seeds come from passes over all vectors that send only a maximum, or a sample
in proportion to the distance left, to the driver; means are added up inside
tasks first.  The assignment is by proposals: every vector proposes to its
nearest centre, a centre keeps the nearest of those that ask up to its
capacity, and the others propose to their next nearest until all are placed.
Its outcome does not depend on the order of the rounds.  Places inside a
centre come from a sort of all proposals in ranges, so no task sorts a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .sampling import farthest_first, matrices, positions


def _nearest_seed(df: DataFrame, seeds: np.ndarray) -> DataFrame:
    """vec_id, embedding and the squared distance d to the nearest seed; unsound vectors are left out."""
    from .sampling import assign

    return df.join(assign(df, seeds).select("vec_id", "d"), "vec_id")


def farthest_seeds(df: DataFrame, k: int) -> np.ndarray:
    """Exactly farthest-first over all vectors, from the one with the least id on: a pass for each seed."""
    @F.arrow_udf("double")
    def least(vectors: pa.Array, before: pa.Array, seed: pa.Array) -> pa.Array:
        out = before.to_numpy(zero_copy_only=False).copy()
        if len(out):
            s = np.array(seed[0].as_py(), np.float64)
            out[:] = np.nan
            for at, v in matrices(vectors, len(s)):
                out[at] = np.fmin(before.to_numpy(zero_copy_only=False)[at], ((v - s) ** 2).sum(axis=1))
        return pa.array(out, from_pandas=True)

    first = df.where("embedding is not null").orderBy("vec_id").select("embedding").first()
    if first is None:
        return np.zeros((1, 1))
    seeds = [first[0]]
    left = df.select("vec_id", "embedding", F.lit(float("inf")).alias("d"))
    while len(seeds) < k:
        seed = F.array(*[F.lit(float(x)) for x in seeds[-1]])
        left = cut(left.select("vec_id", "embedding", least("embedding", "d", seed).alias("d")).where("d is not null"))
        far = left.orderBy(F.col("d").desc(), "vec_id").select("embedding", "d").first()
        if far is None or far["d"] == 0:  # fewer distinct vectors than seeds
            break
        seeds.append(far["embedding"])
    return np.array(seeds, np.float64)


def oversampled_seeds(df: DataFrame, k: int, rounds: int = 5, factor: int = 2, seed: int = 7) -> np.ndarray:
    """k-means||: each round takes about ``factor * k`` vectors with odds in proportion to their squared distance.

    Candidates, about ``rounds * factor * k`` of them, are weighted with the
    vectors nearest to each and thinned to k, farthest first among those with
    at least a tenth of the mean weight.  For many seeds: five passes in all.
    """
    draw = lambda r: F.pmod(F.xxhash64("vec_id", F.lit(seed), F.lit(r)), F.lit(1 << 52)) / float(1 << 52)
    first = df.where("embedding is not null").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").select("embedding").first()
    if first is None:
        return np.zeros((1, 1))
    found = np.array([first[0]], np.float64)
    for r in range(rounds):
        left = cut(_nearest_seed(df, found))
        total = left.agg(F.sum("d")).first()[0]
        if not total:
            break
        more = left.where(draw(r) < F.col("d") * (factor * k / total)).orderBy("vec_id").select("embedding").toArrow().column(0).to_pylist()
        found = np.array([*found.tolist(), *more], np.float64)
    from .sampling import assign

    weight = np.zeros(len(found))
    for c, n in assign(df, found).groupBy("cluster").count().collect():  # a row for each candidate
        weight[c] = n
    able = found[weight >= weight.sum() / len(found) / 10] if len(found) > k else found
    return able[farthest_first(able, k)] if len(able) >= k else found[farthest_first(found, k)]


def means(df: DataFrame, centers: np.ndarray, rounds: int) -> np.ndarray:
    """The centres after some rounds of means; each task adds up its rows before anything is exchanged."""
    centers = np.array(centers, np.float64)
    for _ in range(rounds):
        now = centers

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(now), np.zeros(len(now), np.int64)
            for batch in batches:
                for _, v in matrices(batch.column(0), now.shape[1]):
                    own = np.stack([((v - c) ** 2).sum(axis=1) for c in now], axis=1).argmin(axis=1)
                    np.add.at(total, own, v)
                    n += np.bincount(own, minlength=len(now))
            there = np.flatnonzero(n)
            yield pa.record_batch([pa.array(there.astype(np.int32)), pa.array(n[there]), pa.array(total[there].tolist(), pa.list_(pa.float64()))], names=["cluster", "n", "total"])

        parts = df.select("embedding").mapInArrow(sums, "cluster int, n long, total array<double>")
        parts = parts.select("cluster", "n", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
        centers = centers.copy()
        for r in parts.collect():  # as many numbers as the centres have
            centers[r["cluster"], r["pos"]] = r["x"]
    return centers


def next_choices(df: DataFrame, centers: np.ndarray) -> DataFrame:
    """vec_id, cluster and d: of each row (vec_id, embedding, cluster, d) the nearest centre behind (d, cluster); none left: -1."""
    @F.arrow_udf("struct<cluster:int,d:double>")
    def choice(vectors: pa.Array, last: pa.Array, reach: pa.Array) -> pa.Array:
        cluster, d = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
        last, reach = last.to_numpy(zero_copy_only=False), reach.to_numpy(zero_copy_only=False)
        index = np.arange(len(centers))
        for at, v in matrices(vectors, centers.shape[1]):
            far = np.stack([((v - c) ** 2).sum(axis=1) for c in centers], axis=1)
            tried = (far < reach[at, None]) | ((far == reach[at, None]) & (index <= last[at, None]))
            far = np.where(tried, np.inf, far)
            best = far.argmin(axis=1)
            d[at] = far[np.arange(len(v)), best]
            cluster[at] = np.where(np.isinf(d[at]), -1, best)
        return pa.StructArray.from_arrays([pa.array(cluster), pa.array(d)], ["cluster", "d"])

    return df.select("vec_id", choice("embedding", "cluster", "d").alias("n")).select("vec_id", "n.cluster", "n.d")


def capacity_assigned(df: DataFrame, centers: np.ndarray, capacity: int) -> DataFrame:
    """vec_id, cluster, d and slot: at most ``capacity`` vectors a cluster, the nearest keep their place (ties to the smaller id).

    Vectors that find no room anywhere have no cluster; unsound ones are left out.
    """
    centers = np.asarray(centers, np.float64)
    base = df.select("vec_id", "embedding")
    first = base.withColumn("cluster", F.lit(-1)).withColumn("d", F.lit(-1.0))
    state = cut(next_choices(first, centers).where("cluster >= 0"))
    out = None  # those that no centre takes
    while True:
        placed = cut(positions(state, ["d", "vec_id"], ["cluster"], "slot"))
        refused = placed.where(F.col("slot") >= capacity)
        if refused.isEmpty():
            break
        asking = cut(next_choices(base.join(refused.drop("slot"), "vec_id"), centers))
        none = asking.where("cluster < 0").select("vec_id")
        out = none if out is None else out.unionByName(none)
        state = cut(placed.where(F.col("slot") < capacity).drop("slot").unionByName(asking.where("cluster >= 0")))
    nowhere = F.lit(None)
    if out is not None:
        placed = placed.unionByName(out.select("vec_id", nowhere.cast("int").alias("cluster"), nowhere.cast("double").alias("d"), nowhere.cast("long").alias("slot")))
    return placed


def balanced_kmeans(df: DataFrame, k: int, rounds: int = 6, capacity: int | None = None, seeding: str = "farthest") -> DataFrame:
    """Clusters of nearly equal size: seeds (``farthest``, or ``oversampled`` for many), rounds of means, capacity-bounded assignment."""
    seeds = farthest_seeds(df, k) if seeding == "farthest" else oversampled_seeds(df, k)
    centers = means(df, seeds, rounds)
    return capacity_assigned(df, centers, capacity or -(-df.count() // len(centers)))

"""Query selection, hold-out, placement and clustering of vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.distance import normalized as unit_length
from ..sources.scratch import cut


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, by a hash of the id: the same ones in every run."""
    return df.orderBy(F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}"))), row_id).limit(n)


def first_queries(queries: DataFrame, row_id: str, n: int) -> DataFrame:
    """The first n rows by id, with their position."""
    return dense_index(queries.orderBy(row_id).limit(n), row_id, "position")


def mixed_queries(queries: DataFrame, base: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """position, the row and from_base: at most n queries, and a seeded sample of base rows for those that lack."""
    own = dense_index(queries.orderBy(row_id).limit(n), row_id, "position").withColumn("from_base", F.lit(False))
    there = own.count()
    fill = dense_index(seeded_sample(base, row_id, n - there, seed), row_id, "position").withColumn("position", F.col("position") + there)
    return own.unionByName(fill.withColumn("from_base", F.lit(True)))


def cyclic(queries: DataFrame, row_id: str, n: int) -> DataFrame:
    """Positions 0..n-1 over the available rows, repeated in turn."""
    rows = dense_index(queries, row_id, "_slot")
    total = queries.agg(F.count("*").alias("_n"))
    slots = queries.sparkSession.range(n).withColumnRenamed("id", "position").crossJoin(F.broadcast(total)).withColumn("_slot", F.pmod("position", "_n"))  # one row
    return slots.join(rows, "_slot").drop("_slot", "_n")


def holdout_split(df: DataFrame, row_id: str, held) -> tuple[DataFrame, DataFrame]:
    """Held-out rows, and the others renumbered without gaps.

    Renumbering counts the rows of each id range first, so no task sorts all rows.
    """
    kept = df.where(~held)
    return df.where(held), dense_index(kept, row_id)


def dense_index(df: DataFrame, row_id: str, name: str = "new_id") -> DataFrame:
    """0-based positions in id order."""
    return positions(df, [row_id], [], name)


#: Rows that one task puts in order.
RUN = 65_536


def positions(df: DataFrame, order: list[str], by: list[str], name: str = "position") -> DataFrame:
    """Add each row's 0-based place in ``order`` among the rows with equal ``by`` (all rows, without any).

    Rows are dealt out in ranges of (by, order) and counted there, so neither a
    large group nor an uneven order makes a task sort more than a range.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    rows = cut(df)
    parts = max(1, -(-rows.count() // RUN))
    dealt = rows.withColumns({k: F.col(c) for k, c in zip(keys, by, strict=True)}).repartitionByRange(parts, *[F.col(c) for c in (*keys, *order)])
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)) - 1
    counts = dealt.groupBy("_range", *keys).agg(F.count("*").alias("_n"))  # a row for each range and group in it
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"{k}_") for k in keys], before.alias("_before"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return dealt.withColumn("_in", inside).join(bases, same).withColumn(name, F.col("_in") + F.col("_before")).select(*df.columns, name)


class BadVectors(ValueError):
    """Vectors that cannot be brought to unit length: the lowest row and how many there are."""

    def __init__(self, lowest: int, bad: int):
        super().__init__(f"cannot normalise {bad} vectors, the first of them in row {lowest}")
        self.lowest, self.bad = lowest, bad


def normalized(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``df`` with unit vectors, written and read back; :class:`BadVectors` if any row is null, too short (1e-24) or not finite.

    The lowest bad row is a metric observed by the pass that writes, so no
    task fails for it and all rows have been looked at before it is named.
    """
    seen = Observation()
    unit = unit_length(F.col(vector))
    out = df.withColumn("_unit", unit).observe(seen, F.min(F.when(F.col("_unit").isNull(), F.col(row_id))).alias("lowest"), F.count_if(F.col("_unit").isNull()).alias("bad"))
    out = cut(out.withColumn(vector, F.col("_unit")).drop("_unit"))
    if seen.get["bad"]:
        raise BadVectors(seen.get["lowest"], seen.get["bad"])
    return out


def place(df: DataFrame, row_id: str, parts: int, policy: str, size: int = 16) -> DataFrame:
    """A part for each vector: ``modulo`` deals ids in turn, ``chunk`` in runs, ``stripe`` in runs dealt in turn."""
    i = F.col(row_id)
    part = {"modulo": F.pmod(i, F.lit(parts)), "chunk": F.floor(i / size), "stripe": F.pmod(F.floor(i / size), F.lit(parts))}[policy]
    return df.withColumn("part", part.cast("long"))


def matrices(vectors: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows, as doubles, of the vectors with ``dim`` components that are all finite numbers."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(valid & (sizes == dim))
    if not len(fits):
        return
    flat = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(fits), dim)  # nulls have become NaN
    sound = np.isfinite(v).all(axis=1)
    yield fits[sound], v[sound]


def assign(df: DataFrame, centers: np.ndarray) -> DataFrame:
    """vec_id, cluster and d: the nearest of a few centres (one row each, on the driver) of each vector, ties to the first.

    Vectors that are null, have another length than the centres, or hold a
    null, a NaN or an infinity are assigned to none and left out.
    """
    centers = np.asarray(centers, np.float64)

    @F.arrow_udf("struct<cluster:int,d:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        cluster, d = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
        for at, v in matrices(vectors, centers.shape[1]):
            far = np.stack([((v - c) ** 2).sum(axis=1) for c in centers], axis=1)
            cluster[at] = far.argmin(axis=1)
            d[at] = far[np.arange(len(v)), cluster[at]]
        return pa.StructArray.from_arrays([pa.array(cluster), pa.array(d)], ["cluster", "d"])

    return df.select("vec_id", nearest("embedding").alias("_n")).select("vec_id", "_n.cluster", "_n.d").where("cluster >= 0")


def farthest_first(v: np.ndarray, k: int) -> np.ndarray:
    """Positions of k rows: the first one, then each time the row farthest from those taken."""
    taken, d = [0], ((v - v[0]) ** 2).sum(axis=1)
    while len(taken) < min(k, len(v)):
        taken.append(int(d.argmax()))
        d = np.minimum(d, ((v - v[taken[-1]]) ** 2).sum(axis=1))
    return np.array(taken)


def centroids(df: DataFrame, k: int, sample: int, rounds: int = 6) -> np.ndarray:
    """Centres by farthest-first seeds and a few rounds, on at most ``sample`` vectors (the first by a hash of the id)."""
    rows = df.where("size(embedding) > 0").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    rows = rows.sort_by("vec_id").column("embedding").combine_chunks()
    if not len(rows):
        return np.zeros((1, 1))
    lengths, times = np.unique(np.diff(rows.offsets.to_numpy()), return_counts=True)
    v = np.concatenate([m for _, m in matrices(rows, int(lengths[times.argmax()]))] or [np.zeros((0, 1))])  # of the most frequent length
    if not len(v):
        return np.zeros((1, 1))
    centers = v[farthest_first(v, k)]
    for _ in range(rounds):
        own = np.concatenate([((centers**2).sum(axis=1) - 2 * (v[a : a + 4096] @ centers.T)).argmin(axis=1) for a in range(0, len(v), 4096)])
        for c in np.unique(own):
            centers[c] = v[own == c].mean(axis=0)
    return centers


def kmeans(df: DataFrame, k: int, rounds: int = 6) -> np.ndarray:
    """Centres over all vectors: the same seeds (the smallest id first) and rounds, with sums instead of vectors on the driver."""
    spread = F.posexplode("embedding").alias("pos", "x")
    first = df.orderBy("vec_id").select("embedding").first()
    centers = [first[0]]
    while len(centers) < k:
        far = assign(df, np.array(centers)).orderBy(F.col("d").desc(), "vec_id").limit(1).join(df, "vec_id").select("embedding").first()
        centers.append(far[0])
    centers = np.array(centers, np.float64)
    for _ in range(rounds):
        means = assign(df, centers).join(df, "vec_id").select("cluster", spread).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
        for r in means.collect():  # k rows of as many numbers as a vector has
            centers[r["cluster"], r["pos"]] = r["x"]
    return centers


def balanced(assigned: DataFrame, capacity: int) -> DataFrame:
    """Each vector's slot by distance in its cluster, and whether it is beyond ``capacity``; ``clustering`` moves those."""
    return positions(assigned, ["d", "vec_id"], ["cluster"], "slot").withColumn("overflow", F.col("slot") >= capacity)


def packed_groups(assigned: DataFrame, size: int) -> DataFrame:
    """Groups of ``size`` neighbours in (cluster, distance) order, for storage side by side: vec_id, cluster, pack, place."""
    placed = positions(assigned, ["d", "vec_id"], ["cluster"], "n")
    return placed.select("vec_id", "cluster", F.floor(F.col("n") / size).cast("long").alias("pack"), F.pmod("n", F.lit(size)).cast("long").alias("place"))


def lru_hits(df: DataFrame, key: str, order: list[str], item: str, capacity: int) -> DataFrame:
    """Accesses and hits of a least-recently-used cache for each key, in order; one streaming pass a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cache, seen, hits, out = None, {}, 0, 0, []
        for batch in batches:
            for k, x in zip(batch.column("k").to_pylist(), batch.column("x").to_pylist(), strict=True):
                if k != current:
                    if seen:
                        out.append((current, seen, hits))
                    current, cache, seen, hits = k, {}, 0, 0
                seen += 1
                if x in cache:
                    hits += 1
                    del cache[x]
                elif len(cache) >= capacity:
                    del cache[next(iter(cache))]
                cache[x] = None
        if seen:
            out.append((current, seen, hits))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["k", "accesses", "hits"])

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(item).cast("long").alias("x"), *order)
    return rows.repartition("k").sortWithinPartitions("k", *order).select("k", "x").mapInArrow(run, "k long, accesses long, hits long")

"""Nearest-neighbour joins, exact and pruned, and their evaluation.

Tables are ``(vec_id bigint, embedding array<float>)``.  A theta join of every
query with every base row has no key, so base and queries are dealt into
blocks, and each pair of blocks meets in a cell of its own: an equi-join on
the cell, whose exchange is ``base * query blocks + queries * base blocks``
rows and needs no broadcast.  A cell holds a bounded part of either side,
works on it in numpy, and keeps what may be among a query's k nearest; the
ranked window that follows keeps k rows a query and partition before its own
exchange.  What a cell finds leaves it in runs of a few queries, so joins that
return every pair hold a run of pairs, not a cell's; those that only count
pairs add a run up where it is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import between, prepared
from ..functions.kernels import KERNELS, Bound, bound, distances_of_both, floors, lower_bounds_of, strict_bounds
from ..sources.scratch import cut
from .radius import within
from .sampling import matrices, positions


def blocks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pairs(base: DataFrame, queries: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every query with every base row.  ``queries`` bring their columns under other names than ``base``."""
    n = blocks or blocks_of(base)
    b = base.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    q = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return q.join(b, "_block").drop("_block")


def as_queries(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


def distances(base: DataFrame, queries: DataFrame, name: str = "fp32") -> DataFrame:
    """qid, vec_id, d of every pair (and base's other columns)."""
    others = [c for c in base.columns if c not in ("vec_id", "embedding")]
    b = base.select("vec_id", *others, prepared(name, F.col("embedding")).alias("_v"))
    q = queries.select("qid", prepared(name, F.col("query")).alias("_q"))
    return pairs(b, q).select("qid", "vec_id", *others, between(name, F.col("_q"), F.col("_v")).alias("d"))


def ranked(hits: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k nearest of each query (and ``by``), with rank; ties to the smaller id."""
    w = Window.partitionBy("qid", *(by or [])).orderBy("d", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(base: DataFrame, queries: DataFrame, k: int, name: str = "fp32", where: Column | None = None) -> DataFrame:
    """Exact k nearest neighbours among the base rows that ``where`` admits: qid, rank, vec_id, d."""
    rows = base.where(where) if where is not None else base
    hits = in_cells(rows, queries, _nearest(k) if name == "fp32" else _nearest_by(name, k), "qid long, vec_id long, d double")
    return ranked(hits, k).select("qid", "rank", "vec_id", "d")


def knn_distinct(base: DataFrame, queries: DataFrame, k: int, name: str = "fp32") -> DataFrame:
    """knn for a query list with repeats: each distinct source row is searched once.  ``queries``: position, qid, query."""
    once = queries.select("qid", "query").dropDuplicates(["qid"])
    return queries.select("position", "qid").join(knn(base, once, k, name), "qid")


def range_search(base: DataFrame, queries: DataFrame, radius: float, least: int = 0, most: int | None = None, name: str = "fp32") -> DataFrame:
    """All within ``radius``; at least the ``least`` nearest and at most the ``most`` nearest.

    By L2 this is a join over the cells of pivots; queries with fewer than
    ``least`` hits are searched once more for their nearest.  Other distances
    obey no triangle inequality: every pair is looked at.
    """
    if name == "fp32":
        hits = within(base, queries, radius)
        if least:
            hits = cut(hits)
            enough = hits.groupBy("qid").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("qid")
            short = queries.join(enough, "qid", "left_anti")
            near = knn(base, short, least).select("qid", "vec_id", "d")
            hits = hits.join(enough, "qid", "left_semi").unionByName(near)  # fewer than `least` are within the radius: they are among the nearest
        return (ranked(hits, most) if most is not None else numbered(hits)).select("qid", "rank", "vec_id", "d")
    hits = distances(base.select("vec_id", "embedding"), queries, name)
    if not least:
        hits = hits.where(F.col("d") <= radius)
    hits = ranked(hits, most) if most is not None else numbered(hits)
    return hits.where((F.col("d") <= radius) | (F.col("rank") <= least)).select("qid", "rank", "vec_id", "d")


def numbered(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "vec_id")))


def knn_multivector(base: DataFrame, queries: DataFrame, k: int, doc: str, name: str = "fp32") -> DataFrame:
    """The k nearest documents of each query, a document being as near as its nearest vector.

    Vectors without a document take no part.  A cell keeps each query's k nearest documents by the vectors that it
    holds.  A document among the k nearest of all is among those of the cell
    with its nearest vector, so none is lost.
    """
    numbers = base.where(F.col(doc).isNotNull()).select("vec_id", "embedding", F.col(doc).cast("long").alias("doc_id"))
    hits = in_cells(numbers, queries, _nearest_documents(name, k), "qid long, vec_id long, doc_id long, d double", extra="doc_id")
    best = hits.groupBy("qid", "doc_id").agg(F.min(F.struct("d", "vec_id")).alias("m"))
    w = Window.partitionBy("qid").orderBy("m", "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", F.col("m.vec_id").alias("vec_id"), F.col("m.d").alias("d"))


def filter_and_refine(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact k nearest, refining only candidates whose lower bound is within reach.

    A cell bounds each of its pairs once, from signs and exponents.  The exact
    distances of the k rows with the least bounds give a threshold; rows whose
    bound exceeds it cannot be among the k nearest, the others are refined.
    """
    hits = in_cells(base, queries, _refined(k), "qid long, vec_id long, d double")
    return ranked(hits, k).select("qid", "rank", "vec_id", "d")


def pair_distances(base: DataFrame, queries: DataFrame, names: list[str]) -> DataFrame:
    """qid, vec_id and d0, d1, ... of every pair, by each of the names, in one pass: distances of the registry, or bounds of ``kernels.bound``."""
    return in_cells(base, queries, _every(names), "qid long, vec_id long, " + ", ".join(f"d{i} double" for i in range(len(names))))


def refined(base: DataFrame, queries: DataFrame, steps: list[int]) -> DataFrame:
    """qid, vec_id and b0, b1, ...: the bound of every pair once the first so many dimensions have exact terms.

    The others have those of their signs and exponents, which are no greater,
    so the bounds of a pair do not fall; the last one is the distance.
    """
    return in_cells(base, queries, _refinement(steps), "qid long, vec_id long, " + ", ".join(f"b{i} double" for i in range(len(steps))))


def leading(base: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by id of each length, of those that take part in cells: none beyond is among a query's first ``n`` pairs."""
    sound = base.where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    w = Window.partitionBy(F.size("embedding")).orderBy("vec_id")
    return sound.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def thresholds(pairs: DataFrame, order: str, value: str, k: int, warmup: int, at: list[int]) -> DataFrame:
    """qid, seen, limit: the k-th least value among each query's first ``seen`` rows in order, null before the warm-up."""
    seen = Window.partitionBy("qid").orderBy(order)
    rows = pairs.withColumn("_n", F.row_number().over(seen)).where(F.col("_n") <= max(at))
    rows = rows.withColumn("seen", F.explode(F.array(*[F.lit(n) for n in at]))).where(F.col("_n") <= F.col("seen"))
    place = F.row_number().over(Window.partitionBy("qid", "seen").orderBy(value, order))
    kth = rows.withColumn("_k", place).where(F.col("_k") <= k).groupBy("qid", "seen").agg(F.max(F.when(F.col("_k") == k, F.col(value))).alias("limit"))
    return kth.withColumn("limit", F.when(F.col("seen") >= warmup, F.col("limit")))


def boundaries(base: DataFrame, queries: DataFrame, by: str, other: str, tally: Callable[..., Columns] | None, schema: str, each: Callable[..., Columns] | None = None) -> DataFrame:
    """Each query's scan of the base in id order: every row but the first meets the nearest row before it, by the distance ``by``.

    Rows are dealt out in ranges of ids.  Each range first gives its nearest row; those
    of the earlier ranges are merged for each query, a row a range, and every range
    is gone through from there on.  Gives qid, candidate, boundary and the distances b_exact, c_exact, b_other and
    c_other (or, behind the ids, what ``each`` makes of the columns of distances), or what ``tally`` makes of a query's rows in a range, as ``schema`` names it.  Its arguments are the number of these
    rows and the columns of those that may be nearer than the boundary by either distance; all others are farther by both,
    as their floors tell (:func:`kernels.floors`), and are not looked at.
    """
    placed = cut(positions(base.where("embedding is not null").select("vec_id", "embedding"), ["vec_id"], [], "place"))
    n = max(1, -(-placed.count() // ROWS))
    b = placed.select("vec_id", "embedding", F.floor(F.col("place") / ROWS).alias("block"))
    q = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    exact, second = KERNELS[by], KERNELS[other]
    order = lambda d: np.where(np.isnan(d), np.inf, np.minimum(d, np.finfo(np.float64).max))

    def least(qid, q, ids, v, block):
        for i, at, d in _nearest_by(by, 1)(np.arange(len(q)), q, np.arange(len(ids)), v):
            other_d = [second.distances(second.prepare(q[n]), second.prepare(v[p : p + 1]))[0] for n, p in zip(i, at, strict=True)]
            yield [qid[i], np.full(len(i), block), d, ids[at], np.array(other_d)]

    def through(qid, q, ids, v, b_exact, b_id, b_other, block):
        rows, beside = exact.prepare(v), second.prepare(v)
        for i, x, y, e, a, o in zip(qid, exact.prepare(q), second.prepare(q), b_exact, b_id, b_other, strict=True):
            d, f = distances_of_both(exact, second, x, rows, y, beside)
            none = np.isnan(a)
            key = np.concatenate([[np.inf if none else order(e)], order(d)])
            nearer = np.concatenate([[True], key[1:] < np.minimum.accumulate(key)[:-1]])
            nearer[1] |= none
            at = np.maximum.accumulate(np.where(nearer, np.arange(len(key)), 0))[:-1]
            met = slice(1, None) if none else slice(None)
            at = at[met]
            before = lambda first, own: np.concatenate([[first], own])[at]
            columns = [ids[met], before(-1 if none else int(a), ids), before(e, d), d[met], before(o, f), f[met]]
            if len(at):
                yield [np.array([i]), *tally(len(at), *columns)] if tally else [np.full(len(at), i), *columns[:2], *(each(*columns[2:]) if each else columns[2:])]

    def near(qid, q, ids, v, b_exact, b_id, b_other, block):
        rows, asked, dim = exact.prepare(v), exact.prepare(q), v.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            n2, q2 = (rows * rows).sum(axis=1), (asked * asked).sum(axis=1)
        sound = exact.prepare is second.prepare and np.isfinite(n2).all() and np.isfinite(q2).all()
        low = [floors(name, float(np.abs(rows).max() + np.abs(asked).max())) for name in (by, other)] if sound else [[], []]
        if not low[0] or not low[1]:
            yield from through(qid, q, ids, v, b_exact, b_id, b_other, block)
            return
        slack, one = 8 * (dim + 4) * np.finfo(np.float64).eps, [float(k.finish(np.ones(1))[0]) for k in (exact, second)]
        reach = lambda kind, limit: min((limit / one[kind] + b * dim) / a for a, b in low[kind]) * (1 + 1e-9) + 1e-12
        for run in _runs(len(q), len(ids), PAIRS):
            squares = q2[run][:, None] + n2 - 2 * (asked[run] @ rows.T) - slack * (q2[run][:, None] + n2)
            for i, x, s, e, a, o in zip(qid[run], asked[run], squares, b_exact[run], b_id[run], b_other[run], strict=True):
                start, step, found = 0, 256, []
                if np.isnan(a):
                    (e,), (o,), a, start = exact.distances(x, rows[:1]), second.distances(x, rows[:1]), ids[0], 1
                n = len(ids) - start
                while start < len(ids):
                    part = s[start : start + step]
                    at = np.flatnonzero(part <= reach(0, e)) + start
                    c = exact.distances(x, rows[at])
                    at, c = (z[c < np.minimum.accumulate(np.concatenate([[e], c]))[:-1]] for z in (at, c))  # the boundaries to come
                    f = second.distances(x, rows[at])
                    either = np.union1d(at, np.flatnonzero(part <= reach(1, max(o, f.max(initial=o)))) + start)
                    if len(either):
                        now = np.searchsorted(at, either)
                        d, g = distances_of_both(exact, second, x, rows[either], x, rows[either])
                        found.append([ids[either], np.append(a, ids[at])[now], np.append(e, c)[now], d, np.append(o, f)[now], g])
                    if len(at):
                        e, a, o = c[-1], ids[at[-1]], f[-1]
                    start, step = start + step, min(4 * step, 8192)
                if n:
                    yield [np.array([i]), *tally(n, *([np.concatenate(z) for z in zip(*found, strict=True)] if found else np.empty((6, 0))))]

    first = in_cells(b, q, least, "qid long, block long, e double, id long, o double", blocks=n)
    w = Window.partitionBy("qid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(first).select("qid", "block", F.min(F.struct("e", "id", "o")).over(w).alias("b")).select("qid", "block", F.col("b.e").alias("b_exact"), F.col("b.id").alias("b_id"), F.col("b.o").alias("b_other"))
    return in_cells(b, q.join(before, ["qid", "block"]), near if tally else through, schema, given=["b_exact", "b_id", "b_other"], blocks=n)


def hits_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid and the hits among the first k of ``truth``; queries without a hit count 0."""
    good = found.where(F.col("rank") <= k).select("qid", "vec_id", F.lit(1).alias("_hit"))
    return truth.where(F.col("rank") <= k).join(good, ["qid", "vec_id"], "left").groupBy("qid").agg(F.count("_hit").alias("hits"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: hits / (queries * k)."""
    return hits_at(found, truth, k).agg((F.sum("hits") / (F.count("*") * k)).alias("recall"))


def recall_against(found: DataFrame, truth: DataFrame, k: int, depth: int) -> DataFrame:
    """One row: compared, hits and recall of k results against a truth of ``depth``, where the smaller count is compared."""
    n = min(k, depth)
    hits = truth.where(F.col("rank") <= n).join(found.where(F.col("rank") <= k).select("qid", "vec_id", F.lit(1).alias("_hit")), ["qid", "vec_id"], "left").groupBy("qid").agg(F.count("_hit").alias("hits"))
    return hits.agg((F.count("*") * n).alias("compared"), F.sum("hits").alias("hits"), (F.sum("hits") / (F.count("*") * n)).alias("recall"))


# Cells: a block of queries with a block of base rows.

#: Rows of a block of base rows and of queries; pairs whose fast form is held at once, pairs summed exactly at once, and pairs that leave a cell at once.
ROWS, ASKED = 32_768, 2048
PAIRS, CHUNK, OUT = 1 << 20, 1 << 16, 1 << 17
Columns = list[np.ndarray]
Cell = Callable[..., Iterable[Columns]]


def in_cells(base: DataFrame, queries: DataFrame, cell: Cell, schema: str, rows: int = ROWS, asked: int = ASKED, extra: str | None = None, given: list[str] | None = None, blocks: int | None = None) -> DataFrame:
    """What ``cell`` (query ids, queries, base ids in ascending order, base rows) gives for each pair of blocks, run by run, as columns of ``schema``.

    ``extra`` names a whole-number column of the base that the cell gets as
    well, ``given`` numbers of the queries.  With ``blocks`` both sides bring
    the ``block`` (0 to blocks - 1) in which they meet, which the cell gets last.
    Vectors that are null or hold a null, a NaN or an infinity take no
    part, and vectors of unlike length do not meet.
    """
    more, with_query = [extra] if extra else [], given or []
    b = base.where("embedding is not null").select(F.lit(False).alias("asks"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.size("embedding").alias("dim"), *more, *[F.lit(None).cast("double").alias(g) for g in with_query], *(["block"] if blocks else []))
    q = queries.where("query is not null").select(F.lit(True).alias("asks"), F.col("qid").alias("id"), F.col("query").alias("vec"), F.size("query").alias("dim"), *[F.lit(None).cast("long").alias(c) for c in more], *[F.col(g).cast("double").alias(g) for g in with_query], *(["block"] if blocks else []))
    n = blocks or max(-(-b.count() // rows), min(blocks_of(base), 8))
    m = max(1, -(-q.count() // (asked * (n if blocks else 1))), -(-min(blocks_of(base), 24) // n) if blocks else 1)
    if not blocks:
        b = b.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
        q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = q.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(m)))
    kinds = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.float64()) for c in schema.split(",")])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = pa.Table.from_batches(list(batches))
        mine = sides.column("asks").to_numpy()
        left, right = sides.take(pa.array(np.flatnonzero(mine))), sides.take(pa.array(np.flatnonzero(~mine)))
        del sides
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            (asks, q), (has, v) = _sound(left.column("vec"), dim), _sound(right.column("vec"), dim)
            if len(asks) and len(has):
                ids = right.column("id").to_numpy()[has]
                order = np.argsort(ids, kind="stable")
                others = [right.column(c).to_numpy()[has][order] for c in more] + [left.column(c).to_numpy()[asks] for c in with_query] + ([left.column("block")[0].as_py()] if blocks else [])
                for found in _gathered(cell(left.column("id").to_numpy()[asks], q, ids[order], v[order], *others)):
                    for a in range(0, len(found[0]), OUT):
                        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + OUT], f.type) for x, f in zip(found, kinds, strict=True)], schema=kinds)

    meet = b.unionByName(q).withColumn("cell", (F.col("block") * m + F.col("part")).cast("int")).drop("part")
    # A task a cell: dealt by a hash, some tasks would have several and others none.
    return meet.repartitionById(min(n * m, 4096), "cell").groupBy("cell", "dim").applyInArrow(run, schema)


def _gathered(runs: Iterable[Columns]) -> Iterator[Columns]:
    """Short runs put together, so that not every query makes a batch of its own."""
    have, n = [], 0
    for run in runs:
        have.append(run)
        n += len(run[0])
        if n >= OUT // 8 or len(have) >= 1024:
            yield [np.concatenate(column) for column in zip(*have, strict=True)]
            have, n = [], 0
    if have:
        yield [np.concatenate(column) for column in zip(*have, strict=True)]


def _runs(queries: int, rows: int, most: int) -> Iterator[slice]:
    """Runs of queries whose pairs with so many rows are at most ``most``."""
    step = max(1, most // max(1, rows))
    return (slice(a, a + step) for a in range(0, queries, step))


def _sound(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows of the vectors whose components are all finite numbers."""
    return next(matrices(column, dim), (np.empty(0, np.int64), np.empty((0, dim))))


def _first(d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least, in order; ties to the smaller position."""
    if len(d) > k:
        at = np.flatnonzero(~(d > np.partition(d, k - 1)[k - 1]))  # NaN comes last
        return at[np.argsort(d[at], kind="stable")][:k]
    return np.argsort(d, kind="stable")


def _nearest(k: int) -> Cell:
    """Squared distances as a matrix product, then exact sums of all that its rounding leaves among the k nearest."""

    def cell(qid, q, ids, v):
        n2, take = (v * v).sum(axis=1), min(k, len(ids))
        for run in _runs(len(q), len(ids), PAIRS):
            part = q[run]
            size = n2 + (part * part).sum(axis=1)[:, None]
            approx = size - 2 * (part @ v.T)
            size *= 8 * (v.shape[1] + 4) * np.finfo(np.float64).eps
            reach = np.partition(approx + size, take - 1, axis=1)[:, take - 1 : take]
            row, near = np.nonzero(~(approx - size > reach))
            exact = np.concatenate([((part[row[c : c + CHUNK]] - v[near[c : c + CHUNK]]) ** 2).sum(axis=1) for c in range(0, len(row), CHUNK)])
            best = np.lexsort((near, exact, row))  # base rows are in id order
            row = row[best]
            best = best[np.arange(len(row)) - np.searchsorted(row, row) < take]
            yield [np.repeat(qid[run], take), ids[near[best]], exact[best]]

    return cell


def _nearest_by(name: str, k: int) -> Cell:
    """The k nearest by a distance of the registry: inputs are rounded once a vector.

    A distance that adds up terms of differences is no less than a share of the
    squared distance less a constant (:func:`kernels.floors`).  The distances of the k rows with the
    least squares, a matrix product, give a threshold; rows whose floor exceeds it cannot be among the k nearest.
    """

    def plain(kernel, x, v):
        d = kernel.distances(x, v)
        best = _first(d, k)
        return best, d[best]

    def among(kernel, x, v, left, reach):
        """The k nearest of ``left``, in id order: a later row has to be nearer than all kept, and none is nearer than 0."""
        best, d, a, step = np.empty(0, np.int64), np.empty(0), 0, 256
        while a < len(left) and not (len(best) == k and d[-1] == 0):
            new = left[a : a + step]
            found = kernel.distances(x, v[new])
            near = np.flatnonzero(found <= reach)
            best, d = np.concatenate([best, new[near]]), np.concatenate([d, found[near]])
            first = _first(d, k)
            best, d = best[first], d[first]
            a, step = a + step, min(4 * step, 8192)
        return best, d

    def cell(qid, q, ids, v):
        kernel = KERNELS[name]
        v, q = kernel.prepare(v), kernel.prepare(q)
        with np.errstate(over="ignore", invalid="ignore"):
            n2, q2 = (v * v).sum(axis=1), (q * q).sum(axis=1)
        sound = np.isfinite(n2).all() and np.isfinite(q2).all() and len(ids) > 4 * k
        low = floors(name, float(np.abs(v).max() + np.abs(q).max())) if sound else []
        if not low:
            for i, x in zip(qid, q, strict=True):
                best, d = plain(kernel, x, v)
                yield [np.full(len(best), i), ids[best], d]
            return
        slack, one = 8 * (v.shape[1] + 4) * np.finfo(np.float64).eps, float(kernel.finish(np.ones(1))[0])
        for run in _runs(len(q), len(ids), PAIRS):
            squares = q2[run][:, None] + n2 - 2 * (q[run] @ v.T)
            for i, x, s, own in zip(qid[run], q[run], squares, q2[run], strict=True):
                reach = kernel.distances(x, v[_first(s, k)]).max()
                most = min((reach / one + b * v.shape[1]) / a for a, b in low)
                left = np.flatnonzero(s <= most * (1 + 1e-9) + slack * (own + n2) + 1e-12)
                best, d = among(kernel, x, v, left, reach)
                yield [np.full(len(best), i), ids[best], d]

    return cell


def _nearest_documents(name: str, k: int) -> Cell:
    """The k nearest distinct documents by a distance of the registry, each with its nearest vector."""

    def cell(qid, q, ids, v, docs):
        kernel = KERNELS[name]
        v = kernel.prepare(v)
        for i, x in zip(qid, kernel.prepare(q), strict=True):
            d = kernel.distances(x, v)
            order = np.argsort(d, kind="stable")  # base rows are in id order
            _, first = np.unique(docs[order], return_index=True)
            best = order[np.sort(first)]
            # All documents that are as near as the k-th one stay: their vectors elsewhere decide.
            best = best[: np.searchsorted(d[best], d[best[min(k, len(best)) - 1]], side="right")] if not np.isnan(d[best[min(k, len(best)) - 1]]) else best
            yield [np.full(len(best), i), ids[best], docs[best], d[best]]

    return cell


def _refined(k: int) -> Cell:
    def cell(qid, q, ids, v):
        bounded, exact = strict_bounds(v), KERNELS["fp32"]
        for run in _runs(len(q), len(ids), PAIRS):
            for i, x, low in zip(qid[run], q[run], lower_bounds_of(q[run], bounded), strict=True):
                reach = exact.distances(x, v[_first(low, k)]).max()
                left = np.flatnonzero(low <= reach)
                d = exact.distances(x, v[left])
                best = _first(d, k)
                yield [np.full(len(best), i), ids[left[best]], d[best]]

    return cell


def _every(names: list[str]) -> Cell:
    def cell(qid, q, ids, v):
        kernels = [KERNELS.get(name) or bound(name) for name in names]
        sides = [(k.rows(v), k.query(q)) if isinstance(k, Bound) else (k.prepare(v), k.prepare(q)) for k in kernels]
        for run in _runs(len(q), len(ids), OUT):
            own = qid[run]
            yield [np.repeat(own, len(ids)), np.tile(ids, len(own)), *[np.concatenate([k.distances(x, rows) for x in asked[run]]) for k, (rows, asked) in zip(kernels, sides, strict=True)]]

    return cell


def _refinement(steps: list[int]) -> Cell:
    """All terms are products of a query's side and a row's, so a bound of a run of pairs is a few matrix products."""

    def cell(qid, q, ids, v):
        powers = strict_bounds(v)[1]
        sizes = np.abs(powers)
        for run in _runs(len(q), len(ids), OUT):
            x, out = q[run], []
            for s in steps:
                # With a product p of component and power, the coarse term -p (p < 0) or -2 p is -(3 p + |p|) / 2.
                coarse = 3 * (x[:, s:] @ powers[:, s:].T) + np.abs(x[:, s:]) @ sizes[:, s:].T
                exact = 2 * (x[:, :s] @ v[:, :s].T)
                out.append(((x * x).sum(axis=1)[:, None] + (v * v).sum(axis=1) - exact - coarse).ravel())
            yield [np.repeat(qid[run], len(ids)), np.tile(ids, len(x)), *out]

    return cell


def counted(base: DataFrame, queries: DataFrame, names: list[str] | list[int], count: Callable[..., Columns], schema: str) -> DataFrame:
    """What ``count`` makes of a query's pairs in each cell: it gets arrays of a run, a row a query, for each of the names (of :func:`pair_distances`) or steps (of :func:`refined`).

    Its columns, behind the query's id, have a number for each query and are to be merged over the cells.
    """
    every = _every(names) if isinstance(names[0], str) else _refinement(names)

    def cell(qid, q, ids, v):
        for run in every(qid, q, ids, v):
            yield [run[0][:: len(ids)], *count(*[x.reshape(-1, len(ids)) for x in run[2:]])]

    return in_cells(base, queries, cell, "qid long, " + schema)


def knn_blocked(base: DataFrame, queries: DataFrame, k: int, rows: int = ROWS, asked: int = ASKED) -> DataFrame:
    """knn by L2 with blocks of the given sizes."""
    return ranked(in_cells(base, queries, _nearest(k), "qid long, vec_id long, d double", rows, asked), k).select("qid", "rank", "vec_id", "d")


def top_in_batches(batches: Iterator[DataFrame], queries: DataFrame, k: int) -> DataFrame | None:
    """The running k nearest over base batches."""
    best = None
    for batch in batches:
        new = knn(batch, queries, k).drop("rank")
        best = ranked(new if best is None else best.drop("rank").unionByName(new), k)
    return best

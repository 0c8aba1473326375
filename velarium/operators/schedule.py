"""Bit-step schedules: in how many bits at a time a component should be fetched.

A schedule is a list of widths that do not rise; the last one is repeated until
all bits of a component are there.  A pair of query and row needs as many
leading bits of all components as it takes for the bound to exceed the query's
threshold, all of them if it never does.  A step of width w packs
``FETCH // w`` components into a fetch.  The best schedule has the least product
of fetches over all pairs and padding.

Depths come from cells, one pass over all pairs, as counts by query; schedules
are a table of at most ``MOST`` rows that is joined to those counts by the
bits a schedule has after each step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import Gaps, bound, codes, ends, fp16, gaps
from .search import _runs, in_cells

#: Bits of a component, of which sign and exponent always come first; bits of a fetch; schedules looked at.
BITS, HEAD, FETCH, MOST = 16, 6, 512, 2000
#: Rank of the tables of gaps, pairs bounded at once, pairs summed up one by one at once, and the share of pairs that is left to that.
RANK, PAIRS, EACH, FEW = 8, 1 << 20, 1 << 12, 0.02


def depths(base: DataFrame, queries: DataFrame, threshold: str) -> DataFrame:
    """qid, depth and n: pairs by the leading bits after which the bound exceeds the query's ``threshold`` (a column of squared distances)."""

    def cell(qid, q, ids, v, limits):
        n = _depths_of(q, v, limits)
        at, depth = np.nonzero(n)
        yield [qid[at], depth, n[at, depth]]

    found = in_cells(base, queries, cell, "qid long, depth long, n long", given=[threshold])
    return found.groupBy("qid", "depth").agg(F.sum("n").alias("n"))


def _depths_of(q: np.ndarray, v: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Each query's pairs by depth: a row a query, a column a depth.

    Bounds of all pairs are matrix products with a known error, for as many bits as many pairs need.  Pairs that
    this error leaves open, and the few that need more bits, are summed up one by one.
    """
    n = np.zeros((len(q), BITS + 1), np.int64)
    half, code = fp16(q), codes(v)
    near = ends(code, BITS)[0]
    # Numbers beyond half precision have no table of gaps.
    told, fit = np.isfinite(half).all(axis=1), np.isfinite(near).all(axis=1)
    mine, beside, rows = np.flatnonzero(told), np.flatnonzero(~told), np.flatnonzero(fit)
    tables: dict[int, Gaps | None] = {}
    limit, lost = limits[mine][:, None], np.sqrt(((q[mine] - half[mine]) ** 2).sum(axis=1))[:, None]
    block = max(64, (1 << 21) // (RANK * v.shape[1]))
    for a in range(0, len(rows), block):
        part, taken, pairs = rows[a : a + block], {}, _pairs(q, half, limits, v, code, rows[a : a + block], n)
        # A distance is no less than that of the halves less what rounding moved either side: beyond this, it exceeds the limit as well.
        moved = np.sqrt(((v[part] - near[part]) ** 2).sum(axis=1)).max()
        surely = (np.sqrt(limit) + lost + moved) ** 2 * (1 + 1e-9)
        for run in _runs(len(mine), len(part), PAIRS):
            own = mine[run]
            more, unsure = np.ones((len(own), len(part)), bool), np.zeros((len(own), len(part)), bool)
            for b in range(HEAD, BITS):
                if np.count_nonzero(more) <= FEW * more.size:
                    break
                if b not in tables:
                    tables[b] = gaps(half[mine], code[rows], b, RANK)
                table = tables[b]
                if table is None:
                    break
                if b not in taken:
                    taken[b] = table.take(slice(a, a + block))
                sums = table.sums(run, taken[b])
                beyond, short = sums > surely[run] + table.over[run, None], sums <= limit[run] - table.under[run, None]
                n[own, b] += np.count_nonzero(more & beyond, axis=1)
                unsure |= more & ~(beyond | short)
                more &= short
            at, row = np.nonzero(more | unsure)
            pairs(own[at], row)
        for run in _runs(len(beside), len(part), PAIRS):
            pairs(np.repeat(beside[run], len(part)), np.tile(np.arange(len(part)), len(beside[run])))
    wide = np.flatnonzero(~fit)
    for a in range(0, len(wide), block):
        pairs = _pairs(q, half, limits, v, code, wide[a : a + block], n)
        for run in _runs(len(q), len(wide[a : a + block]), PAIRS):
            own = np.arange(len(q))[run]
            pairs(np.repeat(own, len(wide[a : a + block])), np.tile(np.arange(len(wide[a : a + block])), len(own)))
    return n


def _pairs(q: np.ndarray, half: np.ndarray, limits: np.ndarray, v: np.ndarray, code: np.ndarray, rows: np.ndarray, n: np.ndarray) -> Callable[[np.ndarray, np.ndarray], None]:
    """What adds pairs of a query and one of ``rows`` (by its place there) to ``n``, summed up one by one."""
    step, v, code = bound(f"bits{HEAD}"), v[rows], code[rows]
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(at: np.ndarray, row: np.ndarray) -> None:
        for a in range(0, len(at), EACH):
            i, j = at[a : a + EACH], row[a : a + EACH]
            depth, limit = np.full(len(i), BITS), limits[i]
            left = np.flatnonzero(((q[i] - v[j]) ** 2).sum(axis=1) > limit)
            # Bounds do not fall as bits are added: once one exceeds the limit, the pair is done.
            for b in range(HEAD, BITS):
                if not len(left):
                    break
                if b not in known:
                    known[b] = ends(code, b)
                beyond = step.distances(half[i[left]], tuple(x[j[left]] for x in known[b])) > limit[left]
                depth[left[beyond]] = b
                left = left[~beyond]
            np.add.at(n, (i, depth), 1)

    return add


def widths(bits: int = BITS, most: int = MOST) -> list[list[int]]:
    """Lists of widths that do not rise and add up to at most ``bits``: the widest first, longer ones behind their beginnings."""
    out: list[list[int]] = []
    todo = [[]]
    while todo and len(out) < most:
        have = todo.pop()
        if have:
            out.append(have)
        top = min(have[-1] if have else bits, bits - sum(have))
        todo += [[*have, w] for w in range(1, top + 1)]
    return out


def schedules(spark: SparkSession, bits: int = BITS) -> DataFrame:
    """steps, ends (bits there after each step, the last width repeated): one schedule, the shortest, for each list of ends."""
    rows = {}
    for w in widths(bits):
        ends = []
        while not ends or ends[-1] < bits:
            ends.append((ends[-1] if ends else 0) + w[min(len(ends), len(w) - 1)])
        key = tuple(min(e, bits) for e in ends)
        rows[key] = min(rows.get(key, w), w, key=lambda x: (len(x), x))
    return spark.createDataFrame([(w, list(k)) for k, w in rows.items()], "steps array<int>, ends array<int>")


def costs(counts: DataFrame, dims: int) -> DataFrame:
    """steps, fetches, padding and score of each schedule for the depths of ``counts`` (depth, n)."""
    total = counts.groupBy("depth").agg(F.sum("n").alias("n"))
    packs = lambda w: F.ceil(F.lit(dims) / F.floor(F.lit(FETCH) / w))
    s = schedules(counts.sparkSession)
    width = lambda i: F.get("steps", F.least(i, F.size("steps") - 1))
    # Fetches until each end: a row for each schedule and step.
    steps = s.select("steps", F.posexplode("ends").alias("i", "end"), "ends")
    steps = steps.withColumn("begin", F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(0))
    paid = F.aggregate(F.sequence(F.lit(0), F.col("i")), F.lit(0).cast("long"), lambda t, j: t + packs(width(j)))
    steps = steps.select("steps", "end", "begin", paid.alias("paid"), F.explode(F.sequence(F.col("begin") + 1, F.col("end"))).alias("depth"))
    fetches = steps.join(total, "depth").groupBy("steps").agg(F.sum(F.col("paid") * F.col("n")).alias("fetches"))
    full = F.aggregate("steps", F.lit(0.0), lambda t, w: t + packs(w) * F.floor(F.lit(FETCH) / w) / F.lit(dims) * w)
    padding = full / F.aggregate("steps", F.lit(0), lambda t, w: t + w)
    return fetches.withColumn("padding", padding).withColumn("score", F.col("fetches") * F.col("padding"))


def best(scored: DataFrame) -> DataFrame:
    """One row: the least score, then the fewest steps, then the least widths."""
    return scored.orderBy("score", F.size("steps"), "steps").limit(1)

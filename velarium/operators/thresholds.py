"""A search's threshold as it goes through a table in id order: the k-th least distance so far, refreshed on a schedule.

The table is cut in runs of rows in id order.  First each run gives the k least
distances of each query; those of the earlier runs are merged for each query,
k numbers a run; then every run goes through its rows in order, from that
state on.  So a query's order is kept, and no task sees more than a run of rows.

A threshold is looked at again when so many rows have been seen: after each one
for k up to 5, after every 5 for k up to 20, else at k and after every 20.  Up to
then it stays as it was.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import KERNELS
from ..sources.scratch import cut
from .sampling import matrices, positions

ROWS, ASKED = 65_536, 4096


def next_refresh(seen: int, k: int) -> int:
    """The first refresh at which ``seen`` rows, or more, have been seen."""
    if k <= 5:
        return max(seen, k)
    step = 5 if k <= 20 else 20
    at = -(-seen // step) * step
    return k if seen <= k and k > 20 else max(at, -(-k // step) * step)


def _sides(left: pa.Table, right: pa.Table):
    """Query ids and rows, base places and rows in their order, of one length; None without either."""
    if not left.num_rows or not right.num_rows:
        return None
    dim = left.column("dim")[0].as_py()
    (asks, q), (has, v) = (next(matrices(t.column(c), dim), (np.empty(0, np.int64), np.empty((0, dim)))) for t, c in ((left, "query"), (right, "embedding")))
    if not len(asks) or not len(has):
        return None
    place = right.column("place").to_numpy()[has]
    order = np.argsort(place)
    return asks, q, place[order], v[order]


def running(base: DataFrame, queries: DataFrame, k: int, name: str = "fp32", rows: int = ROWS) -> DataFrame:
    """qid, seen and threshold: each refresh at which a query's threshold changes; rows count in order of vec_id.

    Vectors that are null or not finite count as seen but have no distance.
    """
    placed = cut(positions(base.select("vec_id", "embedding"), ["vec_id"], [], "place"))
    total = placed.count()
    runs, parts = max(1, -(-total // rows)), max(1, -(-queries.count() // ASKED))
    b = placed.where("embedding is not null").select(F.floor(F.col("place") / rows).cast("int").alias("run"), F.size("embedding").alias("dim"), "place", "embedding")
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    q = queries.where("query is not null").select("qid", "query", F.size("query").alias("dim"), F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part"))
    every = q.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    keys, kernel = ["part", "run", "dim"], KERNELS[name]

    def least(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if (sides := _sides(left, right)) is not None:
            asks, x, place, v = sides
            run, v = int(place[0] // rows), kernel.prepare(v)
            for qid, one in zip(left.column("qid").to_numpy()[asks].tolist(), kernel.prepare(x), strict=True):
                d = kernel.distances(one, v)
                out.append((qid, run, np.sort(np.partition(d, k - 1)[:k] if len(d) > k else d).tolist()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.float64())))], names=["qid", "run", "least"])

    def merged(table: pa.Table) -> pa.Table:
        """The k least of all earlier runs, for each run of one query."""
        table, state, out = table.sort_by("run"), [], []
        found = dict(zip(table.column("run").to_pylist(), table.column("least").to_pylist(), strict=True))
        for run in range(runs):
            out.append((run, state))
            state = sorted([*state, *found.get(run, [])])[:k]
        return pa.table([pa.array([table.column("qid")[0].as_py()] * runs, pa.int64()), pa.array([r for r, _ in out], pa.int32()), pa.array([s for _, s in out], pa.list_(pa.float64()))], names=["qid", "run", "before"])

    def through(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if (sides := _sides(left, right)) is not None:
            asks, x, place, v = sides
            v = kernel.prepare(v)
            states = left.column("before").take(pa.array(asks)).to_pylist()
            for qid, one, state in zip(left.column("qid").to_numpy()[asks].tolist(), kernel.prepare(x), states, strict=True):
                d, best, changes, i = kernel.distances(one, v), list(state), {}, 0
                while i < len(d):
                    if len(best) == k:
                        nearer = np.flatnonzero(d[i:] < best[-1])
                        if not len(nearer):
                            break
                        i += int(nearer[0])
                    insort(best, float(d[i]))
                    del best[k:]
                    if len(best) == k:
                        changes[next_refresh(int(place[i]) + 1, k)] = best[-1]
                    i += 1
                out += [(qid, at, limit) for at, limit in changes.items() if at <= total]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["qid", "seen", "threshold"])

    first = every.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(least, "qid long, run int, least array<double>")
    before = first.groupBy("qid").applyInArrow(merged, "qid long, run int, before array<double>")
    asked = every.join(cut(before), ["qid", "run"])
    found = asked.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(through, "qid long, seen long, threshold double")
    # A refresh may lie in the run behind the change; what that run found for it holds.
    return found.groupBy("qid", "seen").agg(F.min("threshold").alias("threshold"))

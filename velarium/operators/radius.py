"""Range joins: all pairs within a radius, by Voronoi cells of pivots.

Pivots are spread over a bounded sample.  Each base row goes to the cell of its
nearest pivot and keeps its distance r to it; of each cell only the least and
greatest r and the number of rows are known to all.  By the triangle
inequality a query's ball meets a cell only if its distance to the pivot is
within the radius of the interval of r, and only if the pivot is no more than
twice the radius farther away than the nearest one.  Queries are sent to the
cells they meet, the join is an equi-join on the cell, and inside it the rows
of the ring that the ball touches are compared.  Large cells are cut in blocks
by a hash of the id, and large query sets in parts, so one task holds a bounded
part of either side however uneven the cells are.

How much is left out depends on the data: tight groups leave a few cells, while
of random directions in many dimensions, all about as far from each other,
every cell is met.  ``cost`` tells.

Defined cases: vectors that are null or hold a null, a NaN or an infinity take
no part, and pairs of unlike length do not meet; an empty side gives no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..sources.scratch import cut
from .sampling import centroids, matrices

#: Rows of a block of a cell, queries of a part, pivots at most, rows for each pivot, and the sample that they are spread over.
ROWS, ASKED, PIVOTS, SHARE, SAMPLE = 65_536, 8192, 1024, 2048, 20_000
#: Distances are compared with a margin for rounding; what remains is settled by exact sums.
MARGIN = 1e-9
PAIRS = 1 << 22
_AT = StructType([StructField("cell", IntegerType()), StructField("r", DoubleType())])


class Cells:
    """Base rows in cells: vec_id, embedding, dim, cell, block and r; the pivots and each cell's extent on the driver."""

    def __init__(self, base: DataFrame, pivots: int | None = None, rows: int = ROWS):
        n = base.count()
        self.pivots = np.ascontiguousarray(centroids(base, pivots or max(1, min(PIVOTS, n // SHARE)), SAMPLE, 0))
        kept = cut(base.select("vec_id", "embedding", F.size("embedding").alias("dim"), _own(self.pivots)("embedding").alias("at")).where("at is not null"))
        kept = kept.select("vec_id", "embedding", "dim", "at.cell", "at.r")
        found = {c: (low, high, m) for c, low, high, m in kept.groupBy("cell").agg(F.min("r"), F.max("r"), F.count("*")).collect()}  # a row for each pivot
        self.extent = np.array([found.get(c, (np.inf, -np.inf, 0)) for c in range(len(self.pivots))])
        self.blocks = np.maximum(1, -(-self.extent[:, 2].astype(np.int64) // rows))
        many = F.element_at(F.array(*[F.lit(int(b)) for b in self.blocks]), F.col("cell") + 1)
        self.rows = kept.withColumn("block", F.pmod(F.xxhash64("vec_id"), many).cast("int"))

    def met(self, queries: DataFrame, radius: float) -> DataFrame:
        """qid, query, dim, and each met cell with its block and the query's distance r to its pivot; ``radius`` is a distance."""
        kind, pivots, extent, blocks = ArrayType(_AT), self.pivots, self.extent, self.blocks

        @F.arrow_udf(kind)
        def cells(vectors: pa.Array) -> pa.Array:
            out: list = [None] * len(vectors)
            for at, v in matrices(vectors, pivots.shape[1]):
                d = _to_pivots(v, pivots)
                reach = radius * (1 + MARGIN) + MARGIN
                hit = (d >= extent[:, 0] - reach) & (d <= extent[:, 1] + reach) & (d - d.min(axis=1, keepdims=True) <= 2 * reach)
                for i, row, near in zip(at, d, hit, strict=True):
                    out[i] = [{"cell": int(c), "r": float(row[c])} for c in np.flatnonzero(near)]
            return pa.array(out, pa.list_(pa.struct([("cell", pa.int32()), ("r", pa.float64())])))

        met = queries.select("qid", "query", F.size("query").alias("dim"), F.explode(cells("query")).alias("at")).select("qid", "query", "dim", "at.cell", "at.r")
        many = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
        return met.withColumn("block", F.explode(F.sequence(F.lit(0), many - 1)))

    def cost(self, queries: DataFrame, radius: float) -> DataFrame:
        """One row: pairs in cells that meet, and all pairs."""
        sizes = F.element_at(F.array(*[F.lit(int(m)) for m in self.extent[:, 2]]), F.col("cell") + 1)
        met = self.met(queries, radius).where("block = 0").agg(F.coalesce(F.sum(sizes), F.lit(0)).cast("long").alias("met"))
        return met.crossJoin(F.broadcast(queries.agg((F.count("*") * int(self.extent[:, 2].sum())).alias("all"))))  # one row each


def _to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, np.stack([((v - p) ** 2).sum(axis=1) for p in pivots], axis=1)))


def _own(pivots: np.ndarray):
    @F.arrow_udf(_AT)
    def own(vectors: pa.Array) -> pa.Array:
        out: list = [None] * len(vectors)
        for at, v in matrices(vectors, pivots.shape[1]):
            d = _to_pivots(v, pivots)
            best = d.argmin(axis=1)
            for i, c, r in zip(at, best, d[np.arange(len(v)), best], strict=True):
                out[i] = {"cell": int(c), "r": float(r)}
        return pa.array(out, pa.struct([("cell", pa.int32()), ("r", pa.float64())]))

    return own


def within(base: DataFrame, queries: DataFrame, squared: float, cells: Cells | None = None, asked: int = ASKED) -> DataFrame:
    """qid, vec_id and d of all pairs whose squared distance d is at most ``squared``."""
    cells = cells or Cells(base)
    radius = float(np.sqrt(max(squared, 0.0)))
    parts = max(1, -(-queries.count() // asked))
    keys = ["part", "cell", "block", "dim"]
    q = cut(cells.met(queries, radius).withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")))
    # Only rows of cells that some query of the part meets are exchanged.
    b = cells.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(q.select(*keys).distinct(), keys, "left_semi")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            q, v = (np.concatenate([m for c in t.column(n).chunks for _, m in matrices(c, dim)]) for t, n in ((left, "query"), (right, "embedding")))
            order = np.argsort(right.column("r").to_numpy(), kind="stable")
            ids, v, r = right.column("vec_id").to_numpy()[order], v[order], right.column("r").to_numpy()[order]
            reach, norms, eps = radius * (1 + MARGIN) + MARGIN, (v * v).sum(axis=1), 8 * (dim + 4) * np.finfo(np.float64).eps
            for i, x, own in zip(left.column("qid").to_numpy(), q, left.column("r").to_numpy(), strict=True):
                a, z = np.searchsorted(r, [own - reach, own + reach])  # the ring of the cell that the ball touches
                z = np.searchsorted(r, own + reach, side="right")
                for k in range(a, z, PAIRS):
                    part = v[k : min(k + PAIRS, z)]
                    size = norms[k : k + len(part)] + x @ x
                    near = np.flatnonzero(size - 2 * (part @ x) <= squared + eps * (size + squared))
                    d = ((part[near] - x) ** 2).sum(axis=1)
                    near, d = near[d <= squared], d[d <= squared]
                    for column, values in zip(found, (np.full(len(d), i), ids[k + near], d), strict=True):
                        column.append(values)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0, k)) for n, c, k in zip(("qid", "vec_id", "d"), found, kinds, strict=True)})

    return q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, "qid long, vec_id long, d double")

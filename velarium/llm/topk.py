"""Exact top-k inner-product search by columnar branch and bound.

Candidates are dealt into blocks by a hash of their row.  A block is held
vertically (one row per dimension); a query adds up its scores a few
dimensions at a time, and after each step drops the candidates whose score so
far plus the most their remaining mass could add (Cauchy-Schwarz over the
remaining dimensions) cannot reach the k-th best of what is certain.  The
survivors' columns are compacted, so later dimensions touch fewer of them.

Sums are 64-bit integers where the block's and the query's largest components
prove that none can overflow.  Otherwise the same search runs on doubles,
scaled by powers of two, and what survives gets its exact sum from whole
numbers of any length.  Bounds are widened by what rounding can have lost, so
results are exact either way.

The queries are a stated set; they meet every block once (``queries x blocks``
rows are exchanged, not ``queries x rows``), and a query's best k of each block
are merged by a ranked window.

Defined cases: vectors that are null, or hold null or non-finite components
(also once scaled), take no part; vectors of different lengths do not meet;
empty vectors meet with score 0; rows with equal ids are rows of their own, as
queries and as candidates, and a query never finds its own row; null ids take
no part; further columns, whatever their names, are not read; an empty table
gives an empty result.  Scores beyond 64 bits are ranked exactly and reported
as the nearest 64-bit value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block's vectors.
BLOCK = 16 << 20
#: Dimensions added between two rounds of pruning.
STEP = 8
#: Blocks at least, so that small tables use all tasks.
LEAST_BLOCKS = 24
MOST = 2**63 - 1
#: Scores at or beyond the ends of 64 bits are told apart by this many hexadecimal digits.
DIGITS = 600


def quantise(vector, scale: int = 256):
    """floor(scale * x) of each component, as doubles hold it; from 2**52 on every double is whole."""
    y = lambda x: x.cast("double") * float(scale)
    return F.transform(vector, lambda x: F.when(F.abs(y(x)) < 2.0**52, F.floor(y(x)).cast("double")).otherwise(y(x)))


def usable(vector, scale: int = 256):
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * float(scale)) < float("inf")))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, float]:
    """x by a power of two, so that no component exceeds 1."""
    top = float(np.abs(x).max(initial=0))
    by = 2.0 ** -np.frexp(top)[1] if top else 1.0
    return x * by, top


class Block:
    """Candidates of one length, in vertical layout."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors, self.dim = rows, ids, vectors, vectors.shape[1]
        self.steps = [slice(i, min(i + STEP, self.dim)) for i in range(0, self.dim, STEP)]
        self.scaled, self.top = _scaled(vectors)
        self.mass = np.stack([(self.scaled[:, s] ** 2).sum(axis=1) for s in self.steps]) if self.steps else np.zeros((0, len(ids)))
        self.total = self.mass.sum(axis=0)
        self.columns: dict[bool, np.ndarray] = {}

    def _columns(self, whole: bool) -> np.ndarray:
        if whole not in self.columns:
            self.columns[whole] = np.ascontiguousarray((self.vectors.astype(np.int64) if whole else self.scaled).T)
        return self.columns[whole]

    def search(self, row: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best but the row itself, best first, ties to the smaller id."""
        alive = np.flatnonzero(self.rows != row)
        if not len(alive):
            return []
        unit, top = _scaled(q)
        whole = max(top, 1.0) * max(self.top, 1.0) * (self.dim + 1) < 2.0**62
        columns, q_ = self._columns(whole), q.astype(np.int64) if whole else unit
        # Bounds live on the scale of the unit vectors; partial sums of whole numbers are brought there.
        back = (2.0 ** -np.frexp(top)[1] if top else 1.0) * (2.0 ** -np.frexp(self.top)[1] if self.top else 1.0) if whole else 1.0
        eps = 8.0 * (self.dim + 4) * np.finfo(np.float64).eps
        parts = [float((unit[s] ** 2).sum()) for s in self.steps]
        q_total = sum(parts)
        heavy = sorted(range(len(self.steps)), key=lambda i: -parts[i])
        partial = np.zeros(len(alive), np.int64 if whole else np.float64)
        rest, q_rest, total = self.total[alive], q_total, self.total[alive]

        def kept(rest: np.ndarray, q_rest: float) -> np.ndarray:
            """Which of the living may be among the k best."""
            # What rounding may have lost of the masses and of the sums is added to the reach.
            reach = np.sqrt((np.maximum(rest, 0) + eps * total) * (max(q_rest, 0.0) + eps * q_total)) * (1 + 1e-9)
            reach += eps * np.sqrt(total * q_total) + self.dim * 2.0**-1060
            seen = partial * back
            sure = seen - reach
            return seen + reach >= np.partition(sure, len(sure) - k)[len(sure) - k]

        for n, i in enumerate(heavy):
            s = self.steps[i]
            for d in range(s.start, s.stop):
                if q_[d]:
                    partial += q_[d] * columns[d, alive]
            rest, q_rest = rest - self.mass[i, alive], q_rest - parts[i]
            if len(alive) > k and (n + 1 < len(heavy) or not whole):
                keep = kept(rest, q_rest) if n + 1 < len(heavy) else kept(np.zeros(len(alive)), 0.0)
                if keep.sum() < 0.8 * len(alive) or n + 1 == len(heavy):
                    alive, partial, rest, total = alive[keep], partial[keep], rest[keep], total[keep]
        ids = self.ids[alive]
        if not whole:
            exact = [int(x) for x in q]
            found = sorted((-sum(a * int(b) for a, b in zip(exact, self.vectors[j], strict=True)), int(self.ids[j])) for j in alive)
            return [(-s, i) for s, i in found[:k]]
        if len(alive) > k:
            keep = partial >= np.partition(partial, len(partial) - k)[len(partial) - k]
            partial, ids = partial[keep], ids[keep]
        best = np.lexsort((ids, -partial))[:k]
        return [(int(partial[j]), int(ids[j])) for j in best]


def _beyond(score: int) -> str | None:
    """An order among scores at or beyond the ends of 64 bits."""
    return f"{score + (1 << 4 * DIGITS - 1):0{DIGITS}x}" if abs(score) >= MOST else None


def _kernel(k: int):
    """Rows come sorted by block and kind (candidates first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, blocks = None, {}, None

        def close() -> dict[int, Block]:
            return {dim: Block(np.array([r for r, _, _ in rows], np.int64), np.array([i for _, i, _ in rows], np.int64), np.array([v for _, _, v in rows], np.float64).reshape(len(rows), dim)) for dim, rows in held.items()}

        for batch in batches:
            found = []
            flat, offsets = batch.column("v").flatten().to_numpy(zero_copy_only=False), batch.column("v").offsets.to_numpy()
            offsets = offsets - offsets[0]
            for n, (g, kind, row, vec_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "kind", "row", "vec_id")), strict=True)):
                v = flat[offsets[n] : offsets[n + 1]]
                if g != block:
                    block, held, blocks = g, {}, None
                if kind == 0:
                    held.setdefault(len(v), []).append((row, vec_id, v))
                    continue
                if blocks is None:
                    blocks, held = close(), {}
                if len(v) in blocks:
                    found += [(row, vec_id, i, min(max(s, -MOST - 1), MOST), _beyond(s)) for s, i in blocks[len(v)].search(row, v, k)]
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate(kinds)], ["row", "query_id", "vec_id", "score", "beyond"])

    return run


def search(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of ``base`` for each of ``queries``; both have row, vec_id (longs) and v, an array of whole doubles.

    ``row`` names a row: a query does not meet the candidate of its own.
    Gives query_id, rank (from 1), vec_id, score.
    """
    size = base.agg(F.sum(F.size("v") + 4) * 8).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK))
    rows = base.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("g"), F.lit(0).alias("kind"), "row", "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("g"), F.lit(1).alias("kind"), "row", "vec_id", "v")
    met = rows.unionByName(asked).repartition(blocks, "g").sortWithinPartitions("g", "kind")
    hits = met.mapInArrow(_kernel(k), "row long, query_id long, vec_id long, score long, beyond string")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def prepared(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    e = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), scale))
    return e.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding"), scale).alias("v"))

"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and the 4-, 5- and
6-character beginnings of its longer words (insults of inflected languages
share a stem).  Terms are hashed into ``2**bits`` buckets.  A bucket carries a
weight and a latent vector if it occurs in two toxic rows and tells the classes
apart more than the best of as many unrelated buckets would by chance
(chi-square), either among all training rows or among those that hold a bucket
found so: the second count finds terms that mean something only beside another
one.  How many there are follows from the labels.  The model's score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j),

so a pair of terms can count for more, or less, than its two weights.

Training uses at most ``sample`` labelled ids (chosen by a hash of the id, one
row each, worked on in the order of their ids, so runs agree); scoring reads
every whole text.

Defined cases: null or empty texts have no terms and get the score of the bias
alone; a null id is never in the training rows; repeated labels of an id count
once (toxic wins), and of its repeated rows the least text does; without both
classes among the labels the model is the constant base rate; columns named
``score`` or ``predicted`` are replaced, others pass through; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .wordbpe import runs

#: Runs of letters and digits.
TOKEN = re.compile(r"[^\W_]+")
#: Word beginnings that also count as terms.
STEMS = (4, 5, 6)
#: Entries of the per-worker memo from word to feature numbers.
MEMO = 300_000


@dataclass(frozen=True)
class Params:
    sample: int = 20_000  #: most labelled ids a model is fitted on
    bits: int = 18  #: hash buckets, as a power of two
    rank: int = 8  #: length of the latent vectors
    steps: int = 160  #: full-batch Adam steps
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class Model:
    bits: int
    buckets: np.ndarray  #: hash bucket of each feature
    bias: float
    weights: np.ndarray
    latent: np.ndarray

    def margin(self, x: list[int]) -> float:
        if not x:
            return self.bias
        v = self.latent[x]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[x].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))


def _buckets(word: str, bits: int) -> list[int]:
    mask = (1 << bits) - 1
    found = [zlib.crc32(word.encode()) & mask]
    found += [zlib.crc32(f"^{word[:n]}".encode()) & mask for n in STEMS if len(word) >= n]
    return found


def _terms(text: str | None, bits: int) -> set[int]:
    return {b for w in set(TOKEN.findall((text or "").lower())) for b in _buckets(w, bits)}


def _featurise(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column("text")):
                rows = [np.array(sorted(_terms(t.as_py(), bits)), np.int32) for t in batch.column("text").slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("toxic").slice(a, b - a), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    return run


def _tally(bits: int, beside: np.ndarray | None):
    """Document counts per bucket and class of one partition; at most ``2**bits`` rows.  ``beside``: only of rows with one of these buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        rows = np.zeros(2, np.int64)
        known = np.zeros(1 << bits, bool)
        if beside is not None:
            known[beside] = True
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            terms = batch.column("terms")
            size, flat = np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            counted = np.bincount(owner[known[flat]], minlength=len(size)) > 0 if beside is not None else np.ones(len(size), bool)
            for label in (0, 1):
                own = counted & (toxic == label)
                rows[label] += own.sum()
                counts[label] += np.bincount(flat[own[owner]], minlength=1 << bits)
        kept = np.flatnonzero(counts[1] > 0)
        # The rows of either class come as a bucket of their own, -1.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1).astype(np.int32)), *(pa.array(np.append(c[kept], n)) for c, n in zip(counts, rows, strict=True))], ["bucket", "clean", "toxic"])

    return run


def _telling(rows: DataFrame, bits: int, beside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that tell the classes apart, in order, and which of them speak for toxicity."""
    sums = rows.mapInArrow(_tally(bits, beside), "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = sums.toArrow().sort_by("bucket")  # at most 2**bits rows and one
    bucket, c, t = (found.column(n).to_numpy() for n in ("bucket", "clean", "toxic"))
    if not len(bucket) or not c[0] or not t[0]:
        return np.zeros(0, np.int32), np.zeros(0, bool)
    (n0, n1), bucket, c, t = (float(c[0]), float(t[0])), bucket[1:], c[1:].astype(float), t[1:].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (t * (n0 - c) - c * (n1 - t)) ** 2 * (n0 + n1) / ((t + c) * (n0 + n1 - t - c) * n0 * n1)
    tried = (t >= 2) & (t + c < n0 + n1)
    # The greatest of m unrelated chi-squares is about 2 ln m.
    keep = tried & (chi >= 2 * np.log(max(tried.sum(), 1)))
    return bucket[keep], (t / n1 > c / n0)[keep]


def _chosen(buckets: np.ndarray):
    """Each row's features: the places of its terms among the buckets, which are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            flat, size = terms.flatten().to_numpy(), np.diff(terms.offsets.to_numpy())
            at = np.minimum(np.searchsorted(buckets, flat), len(buckets) - 1)
            hit = buckets[at] == flat
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(size)), size)[hit], minlength=len(size)))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[hit].astype(np.int32)))], ["doc_id", "toxic", "x"])

    return run


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """``labelled``: doc_id long, text string, toxic int; at most ``params.sample`` rows, as :func:`training_rows` gives them."""
    rows = cut(labelled.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int")).mapInArrow(_featurise(params.bits), "doc_id long, toxic int, terms array<int>"))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        rate = min(max((n1 + 0.5) / (n0 + n1 + 1), 0.01), 0.99) if n0 + n1 else 0.25
        return Model(params.bits, np.zeros(0, np.int32), float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, params.rank)))
    buckets, speaks = _telling(rows, params.bits)
    if speaks.any():
        buckets = np.union1d(buckets, _telling(rows, params.bits, buckets[speaks])[0]).astype(np.int32)
    if not len(buckets):
        return Model(params.bits, buckets, float(np.log(n1 / n0)), np.zeros(0), np.zeros((0, params.rank)))
    table = rows.mapInArrow(_chosen(buckets), "doc_id long, toxic int, x array<int>").toArrow().sort_by("doc_id")  # params.sample rows
    x = table.column("x").combine_chunks()
    return _train(params, buckets, x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(x.offsets.to_numpy()))]), table.column("toxic").to_numpy().astype(np.float64))


def _sums(values: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Sums of the runs of rows that begin there; the last one ends with the rows."""
    out = np.zeros((n, values.shape[1]))
    some = np.diff(np.append(begin, len(values))) > 0
    if some.any():
        out[some] = np.add.reduceat(values, begin[some], axis=0)
    return out


class Training:
    """Rows of features (0 or 1, so x * x = x), in the order of rows and in that of features."""

    def __init__(self, on: np.ndarray, ends: np.ndarray, y: np.ndarray, features: int):
        self.on, self.begin, self.y, self.features = on, ends[:-1], y, features
        order = np.argsort(on, kind="stable")
        self.row = np.repeat(np.arange(len(y)), np.diff(ends))[order]
        self.first = np.searchsorted(on[order], np.arange(features))

    def gradient(self, state: list[np.ndarray], decay: float) -> tuple[float, list[np.ndarray]]:
        """The mean logistic loss with half ``decay`` times the squares, and its gradient."""
        bias, w, v = state
        rank = v.shape[1]
        z = _sums(np.hstack([v, w[:, None], (v * v).sum(axis=1, keepdims=True)])[self.on], self.begin, len(self.y))
        s = z[:, :rank]
        margin = bias[0] + z[:, rank] + 0.5 * ((s * s).sum(axis=1) - z[:, rank + 1])
        loss = np.logaddexp(0, np.where(self.y > 0, -margin, margin)).mean() + decay / 2 * ((w * w).sum() + (v * v).sum())
        g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - self.y) / len(self.y)
        of = _sums(np.hstack([g[:, None] * s, g[:, None]])[self.row], self.first, self.features)
        return float(loss), [np.array([g.sum()]), of[:, rank] + decay * w, of[:, :rank] - v * of[:, rank:] + decay * v]


def _train(params: Params, buckets: np.ndarray, on: np.ndarray, ends: np.ndarray, y: np.ndarray) -> Model:
    """Full-batch Adam on the logistic loss; row n has the features ``on[ends[n]:ends[n + 1]]``."""
    rows = Training(on, ends, y, len(buckets))
    draw = np.random.default_rng(params.seed)
    state = [np.array([np.log(y.mean() / (1 - y.mean()))]), np.zeros(len(buckets)), draw.normal(0, 0.01, (len(buckets), params.rank))]
    first, second = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    for step in range(1, params.steps + 1):
        for p, d, m, q in zip(state, rows.gradient(state, params.decay)[1], first, second, strict=True):
            m += 0.1 * (d - m)
            q += 0.001 * (d * d - q)
            p -= params.rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    bias, w, v = state
    return Model(params.bits, buckets, float(bias[0]), w, v)


def training_rows(documents: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """Id, text and label of at most ``params.sample`` ids outside the held-out fifth.

    The chosen ids are bounded by ``params.sample``, so they may be broadcast.
    """
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(params.seed)), "doc_id").limit(params.sample)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def held_out(doc_id):
    """The fifth of the ids that no model has seen."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (double, 0 to 1) and ``predicted`` (int)."""
    number = {int(b): i for i, b in enumerate(model.buckets)}

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in texts:
            margins = np.empty(len(batch))
            for k, value in enumerate(batch):
                on: set[int] = set()
                for w in set(TOKEN.findall((value.as_py() or "").lower())):
                    hit = memo.get(w)
                    if hit is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        hit = tuple(number[b] for b in _buckets(w, model.bits) if b in number)
                        memo[w] = hit
                    on.update(hit)
                margins[k] = model.margin(sorted(on))
            yield pa.array(1 / (1 + np.exp(-np.clip(margins, -700, 700))))

    out = df.drop("score", "predicted").withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

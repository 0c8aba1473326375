"""Exact top-k search against brute force and its SQL."""

import math
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from velarium.llm import topk
from velarium.llm.oracles import OP2


def brute(rows, k):
    """(query id, rank, id, score) of every query row, from whole numbers of any length."""
    ok = [(i, [math.floor(256 * Fraction(float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, (i, b) in enumerate(ok) if m != n and len(b) == len(a))[:k]
            out += [(q, r, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scored, 1)]
    return Counter(out)


def found(spark, rows, kind="float", k=5):
    df = spark.createDataFrame([(i, v, "clash", -1) for i, v in rows], f"vec_id long, embedding array<{kind}>, query_id string, score int").repartition(3)
    base = topk.prepared(df)
    return Counter(tuple(r) for r in topk.search(base, base.where("vec_id % 50 = 0"), k).select("query_id", "rank", "vec_id", "score").collect())


def odd_vectors():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 20)).astype(np.float32)
    vectors[7] = vectors[3]
    vectors[200:260] = np.round(vectors[200:260])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 20), (None, [1.0] * 20), (1050, [1.0, 2.0]), (1051, [2.0, 2.0]), (1100, []), (1101, [])]
    # Ids that occur again: the same vector, and others, as candidates and as queries.
    return [*rows, rows[3], (3, vectors[50].tolist()), (50, vectors[60].tolist()), rows[100], rows[100]]


def test_equals_brute_force(spark):
    rows = odd_vectors()
    assert found(spark, rows) == brute(rows, 5)


def test_a_hot_id_and_ties(spark):
    rows = [(50, [float(i % 3), 1.0]) for i in range(200)] + [(i, [1.0, 1.0]) for i in range(100)]
    assert found(spark, rows) == brute(rows, 5)


def test_components_beyond_64_bits(spark):
    rows = [(0, [1 / 256, 1 / 256]), (1, [1e17, -9.99e16]), (2, [1e17, -1e17]), (50, [-1e12, 7.0]), (100, [1e30, 1.0]), (3, [1e30, -5.0]), (4, [3.0, 4.0]), (5, [-1e300, 2e-300]), (6, [1e300, 0.0]), (7, [2e300, -0.0])]
    for k in (1, 3, 9):
        assert found(spark, rows, "double", k) == brute(rows, k)
    assert found(spark, rows[:2], "double") == Counter({(0, 1, 1, 25_600_000_000_000_000): 1})


@pytest.mark.parametrize("size", [2.0**10, 2.0**22, 2.0**23 - 1, 2.0**40])
def test_bounds_are_rounded_outwards(size):
    rng = np.random.default_rng(int(size))
    vectors = np.floor(rng.normal(size=(3000, 64)) * size)
    block = topk.Block(np.arange(3000), np.arange(3000) % 1000, vectors)
    for n in range(0, 3000, 500):
        q = [int(x) for x in vectors[n]]
        want = sorted((-sum(a * int(b) for a, b in zip(q, v, strict=True)), i % 1000) for i, v in enumerate(vectors) if i != n)[:7]
        assert block.search(n, vectors[n], 7) == [(-s, i) for s, i in want]


def test_pruning_drops_candidates():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(4000, 64)) * 256 / (1 + np.arange(64)))
    block = topk.Block(np.arange(4000), np.arange(4000), vectors)
    touched = []
    block._columns(True)
    columns = block.columns[True]

    class Seen(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple):
                touched.append(len(at[1]))
            return np.asarray(self).__getitem__(at)

    block.columns[True] = columns.view(Seen)
    block.search(3, vectors[3], 5)
    assert touched[-1] < 400 and sum(touched) < 0.5 * 64 * 4000


def test_sql_keeps_rows_with_equal_ids(spark, tmp_path):
    rows = [(i, v) for i, v in odd_vectors() if v is None or None not in v]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert Counter(c.execute(OP2).fetchall()) == brute(rows, 5)


def test_empty(spark):
    assert not found(spark, [])

"""Bounded counters against dictionaries, and mapped vector files."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from velarium.operators import memory
from velarium.sources import vectors


def accesses(seed, n=3000):
    draw = random.Random(seed)
    return [(draw.randrange(3), t, t // 400, int(draw.paretovariate(0.8)) % 60) for t in range(n)]


def test_spilling_counters_bound_every_item(spark):
    rows = accesses(1)
    df = spark.createDataFrame(rows, "k long, t long, e long, x long").repartition(4)
    held = {(r["k"], r["epoch"], r["item"]): (r["n"], r["spill"]) for r in memory.spilled(df, "k", ["t"], "x", F.col("e"), 8).collect()}
    exact = Counter((k, e, x) for k, _, e, x in rows)
    total = Counter((k, e) for k, _, e, _ in rows)
    per_table = Counter((k, e) for k, e, _ in held)
    assert max(per_table.values()) == 8
    for (k, e, x), n in exact.items():
        if n * 9 > total[k, e]:
            assert (k, e, x) in held
        if (k, e, x) in held:
            kept, spill = held[k, e, x]
            assert n <= kept <= n + spill and spill * 9 <= total[k, e]


def plain_pruned(rows, rate, most):
    out, tables, epochs = [], {}, {}
    for k, _, e, x in rows:
        table = tables.setdefault(k, {})
        for _ in range(e - epochs.get(k, e)):
            for i in list(table):
                if table[i][0] < table[i][1] * rate:
                    del table[i]
                else:
                    table[i][1] += 1
        epochs[k] = e
        entry = table.setdefault(x, [0, 0])
        entry[0] += 1
        if entry[0] >= most:
            del table[x]
            out.append((k, e, x))
    return Counter(out)


def test_pruned_counters(spark):
    rows = accesses(2)
    df = spark.createDataFrame(rows, "k long, t long, e long, x long").repartition(4)
    got = Counter(tuple(r) for r in memory.pruned(df, "k", ["t"], "x", F.col("e"), 3, 20).collect())
    assert got == plain_pruned(rows, 3, 20) and got


def test_bloom_never_misses(spark):
    rows = accesses(3)
    df = spark.createDataFrame(rows, "k long, t long, e long, x long")
    got = {(r["epoch"], r["item"]): r["n"] for r in memory.listed_by_bloom(df, "x", F.col("e"), 64, 3, 30).collect()}
    exact = Counter((e, x) for _, _, e, x in rows)
    for (e, x), n in exact.items():
        both = n + exact.get((e - 1, x), 0)
        if both >= 30:
            assert got[e, x] >= both


def test_translation_is_one_to_one(spark):
    pages = spark.range(1 << 10).select(memory.translated(F.col("id") * 4096 + 5, 12, 10, 77, 3).alias("p"))
    assert pages.distinct().count() == 1 << 10 and pages.where("p % 4096 <> 5").count() == 0
    with pytest.raises(ValueError):
        memory.translated(F.col("id"), 12, 10, 4, 3)


@pytest.mark.parametrize("layout", ["fbin", "fvecs", "ibin", "ivecs"])
def test_mapped_vector_files(tmp_path, layout):
    rows = np.arange(60).reshape(12, 5)
    kind = {"fbin": "<f4", "fvecs": "<f4", "ibin": "<u4", "ivecs": "<i4"}[layout]
    body = rows.astype(kind)
    if layout.endswith("bin"):
        raw = np.array([12, 5], "<i4").tobytes() + body.tobytes()
    else:
        raw = b"".join(np.array([5], "<i4").tobytes() + r.tobytes() for r in body)
    path = tmp_path / f"x.{layout}"
    path.write_bytes(raw)
    file = vectors.VectorFile(str(path), layout)
    assert (file.rows, file.dim) == (12, 5)
    assert (file.slice(3, 7) == rows[3:7]).all() and (file.rows_at([11, 0, 3]) == rows[[11, 0, 3]]).all()
    assert len(file.slice(4, 4)) == len(file.rows_at([])) == 0
    for bad in (lambda: file.slice(3, 13), lambda: file.rows_at([12]), lambda: file.rows_at([-1])):
        with pytest.raises(IndexError):
            bad()

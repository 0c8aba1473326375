"""Keyed state over batches and restarts, sketches, SQL functions, schedules, strict normalisation."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from velarium.functions import kernels
from velarium.functions import bounds as columns
from velarium.operators import sampling, schedule, search, sketches, surface, thresholds
from velarium.streaming import jobs, state

MINUTE = 60_000_000
START = datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, key string, value string"


def rows_of(n, seed, spread=20):
    """Events in arrival order, each up to ``spread`` minutes out of order."""
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += rng.choice([1, 2, 5, 90])
        out.append((i, START + timedelta(minutes=at - rng.randrange(spread)), rng.choice("abc"), rng.choice(["x", "y"])))
    return out


def plain_runs(rows, idle):
    out = []
    for key in sorted({r[2] for r in rows}):
        run = None
        for _, ts, _, value in sorted((r for r in rows if r[2] == key), key=lambda r: (r[1], r[0])):
            if run and run[1] == value and (ts - run[3]).total_seconds() <= idle * 60:
                run = (*run[:3], ts, run[4] + 1)
            else:
                if run:
                    out.append(run)
                run = (key, value, ts, ts, 1)
        out.append(run)
    return sorted((k, v, int((a - START).total_seconds()) // 60, int((b - START).total_seconds()) // 60, n) for k, v, a, b, n in out)


def plain_flights(rows, span):
    out = []
    for key in sorted({r[2] for r in rows}):
        held = None
        for _, ts, _, value in sorted((r for r in rows if r[2] == key), key=lambda r: (r[1], r[0])):
            if held and (ts - held[2]).total_seconds() < span * 60:
                held[3] += 1
            else:
                if held:
                    out.append(held)
                held = [key, value, ts, 0]
        out.append(held)
    return sorted((k, v, int((a - START).total_seconds()) // 60, n) for k, v, a, n in out)


def feed(spark, rows, path, batches):
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@pytest.mark.parametrize("batches", [1, 4])
def test_runs_over_batches_and_a_restart(spark, tmp_path, batches):
    at, rows = f"file://{tmp_path}", rows_of(120, 1)
    minute = lambda c: F.floor((F.col(c) - int(START.timestamp()) * 1_000_000) / MINUTE)
    args = (state.Runs(60 * MINUTE), "key", "ts", "id", "value", "30 minutes", at)
    feed(spark, rows, at, batches)
    early = state.folded(stream(spark, at), *args).count()
    beat = [(10_000, rows[-1][1] + timedelta(days=30), "end", "z"), (None, START, "a", "x"), (10_001, rows[-1][1] + timedelta(days=30), None, "x")]
    feed(spark, beat, at, 1)
    found = state.folded(stream(spark, at), *args)
    got = sorted((r["key"], r["value"], r["a"], r["b"], r["n"]) for r in found.select("key", "value", minute("first").alias("a"), minute("last").alias("b"), "n").collect())
    want = plain_runs(rows, 60)
    assert got == want and (early > 0 if batches > 1 else early < len(want))


def test_ids_in_flight(spark, tmp_path):
    at, rows = f"file://{tmp_path}", rows_of(150, 2)
    args = (state.InFlight(200 * MINUTE), "key", "ts", "id", "value", "30 minutes", at)
    feed(spark, rows, at, 3)
    state.folded(stream(spark, at), *args)
    feed(spark, [(10_000, rows[-1][1] + timedelta(days=30), "end", "z")], at, 1)
    minute = F.floor((F.col("first") - int(START.timestamp()) * 1_000_000) / MINUTE)
    found = state.folded(stream(spark, at), *args).select("key", "value", minute.alias("a"), "n").collect()
    assert sorted(tuple(r) for r in found) == plain_flights(rows, 200)


def test_the_state_store_is_set_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with state.state_store(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


def test_sketches_merge(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, START + timedelta(seconds=int(s)), f"u{u}", float(v)) for i, (s, u, v) in enumerate(zip(rng.integers(0, 86_400, 6000), rng.integers(0, 900, 6000), rng.normal(size=6000), strict=True))]
    rows += [(6000 + i, START, "hot", 0.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, who string, x double")
    kept = jobs.sketch_states(jobs.replay(df, f"file://{tmp_path}", 3), "ts", "1 hour", "who", "x", f"file://{tmp_path}")
    assert kept.count() > 24  # a row for each hour and batch
    e = sketches.estimates(sketches.merged(kept), [0.25, 0.95], 2).first()
    x = np.sort([r[3] for r in rows])
    assert e["n"] == 8000 and abs(e["active"] - 901) <= 4 * sketches.SPREAD * 901
    for q, share in zip(e["quantiles"], (0.25, 0.95), strict=True):
        assert np.searchsorted(x, q, "left") / 8000 <= share + sketches.RANK and np.searchsorted(x, q, "right") / 8000 >= share - sketches.RANK
    assert e["top"][0]["item"] == "hot" and e["top"][0]["count"] >= 2000
    hours = sketches.active(df, "ts", "1 hour", "who")
    counts = sorted(r["active"] for r in hours.collect())
    got = sketches.over_epochs(hours, "active").first()
    assert (got["epochs"], got["percentile"]) == (len(counts), counts[-(-len(counts) * 95 // 100) - 1]) and got["mean"] == pytest.approx(np.mean(counts))


def test_sql_functions(spark):
    surface.register(spark)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [1.0]), (103, [float("nan")] * 5)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "vec_id long, embedding array<double>")
    df.createOrReplaceTempView("some_vectors")
    text = "SELECT a.vec_id AS i, b.vec_id AS j, vector_distance('fp16_fpma', a.embedding, b.embedding) AS d, vector_distance('ip', a.embedding, b.embedding) AS p FROM some_vectors a JOIN some_vectors b ON b.vec_id >= 58 AND a.vec_id < 104"
    for r in spark.sql(text).collect():
        both = r["i"] < 60 and r["j"] < 60 or r["i"] == r["j"] == 102
        assert (r["d"] is None) != both
        if both and r["i"] < 60:
            half, kernel = kernels.KERNELS["fp16_fpma"], v[r["j"]][None]
            assert r["d"] == half.distances(half.prepare(v[r["i"]]), half.prepare(kernel))[0] and r["p"] == pytest.approx(1 - v[r["i"]] @ v[r["j"]])
    text = (
        "SELECT qid, vec_id, d FROM nearest(TABLE(SELECT false AS asked, vec_id AS id, embedding AS vec, vec_id % 3 AS cell FROM some_vectors "
        "UNION ALL SELECT true, vec_id, embedding, explode(sequence(0L, 2L)) FROM some_vectors WHERE vec_id % 10 = 0) PARTITION BY (cell), 4, 'fp32')"
    )
    found = search.ranked(spark.sql(text), 4).select("qid", "rank", "vec_id").collect()
    want = search.knn(df, search.as_queries(df.where("vec_id % 10 = 0")), 4).select("qid", "rank", "vec_id").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(want) == 24


def test_bounds_on_blocks_are_those_of_columns(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(30, 40)), np.zeros((1, 40)), rng.normal(size=(5, 40)) * 1e-6])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    queries = search.as_queries(df.where("vec_id < 5"))
    names = ["unit", "l2", "bits6", "bits9", "first16"]
    found = {(r["qid"], r["vec_id"]): [r[f"d{i}"] for i in range(5)] for r in search.pair_distances(df, queries, names).collect()}
    q, e = F.col("query"), F.col("embedding")
    want = search.pairs(df, queries).select(
        "qid", "vec_id", columns.lower_bound_unit(q, e), columns.lower_bound_l2(q, e), columns.lower_bound_bits(columns.half(q), columns.intervals(e, 6)), columns.lower_bound_bits(columns.half(q), columns.intervals(e, 9)), columns.partial_distance(q, e, 16)
    )
    for r in want.collect():
        assert found[r[0], r[1]] == pytest.approx(list(r)[2:], abs=1e-9)


def test_schedules(spark):
    lists = schedule.widths(5)
    assert len(lists) == 1 + 2 + 3 + 5 + 7 and all(w == sorted(w, reverse=True) and sum(w) <= 5 for w in lists)
    table = {tuple(r["ends"]): r["steps"] for r in schedule.schedules(spark, 4).collect()}
    assert table[1, 2, 3, 4] == [1] and table[2, 4] == [2] and table[3, 4] == [3] and table[2, 3, 4] == [2, 1]  # [3, 1] ends like [3]
    counts = spark.createDataFrame([(8, 100), (16, 3)], "depth int, n long")
    scored = {tuple(r["steps"]): (r["fetches"], r["score"]) for r in schedule.costs(counts, 128).collect()}

    def plain(steps):
        fetches = 0
        for depth, n in ((8, 100), (16, 3)):
            at, i = 0, 0
            while at < depth:
                w = steps[min(i, len(steps) - 1)]
                fetches += n * -(-128 // (512 // w))
                at, i = at + w, i + 1
        return fetches, fetches * sum(-(-128 // (512 // w)) * (512 // w) / 128 * w for w in steps) / sum(steps)

    for steps, (fetches, score) in scored.items():
        assert (fetches, pytest.approx(score)) == plain(list(steps))
    assert tuple(schedule.best(schedule.costs(counts, 128)).first()["steps"]) == min(scored, key=lambda k: (scored[k][1], len(k), k))


def test_depths(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    queries = search.as_queries(df.where("vec_id < 4")).withColumn("reach", F.lit(6.0))
    found = {(r["qid"], r["depth"]): r["n"] for r in schedule.depths(df, queries, "reach").collect()}
    want = {}
    for i in range(4):
        for x in v:
            depth = next((b for b in range(6, 16) if kernels.bound(f"bits{b}").distances(kernels.fp16(v[i]), kernels.intervals(x[None], b))[0] > 6.0), 16)
            depth = depth if ((v[i] - x) ** 2).sum() > 6.0 else 16
            want[i, depth] = want.get((i, depth), 0) + 1
    assert found == want


def test_strict_normalisation_names_the_lowest_row(spark):
    rows = [(i, [3.0, 4.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert {tuple(r["embedding"]) for r in sampling.normalized(df).collect()} == {(0.6, 0.8)}
    for bad in ([0.0, 0.0], [float("inf"), 1.0], [float("nan"), 1.0], None, [1e-13, 0.0]):
        with pytest.raises(sampling.BadVectors) as e:
            sampling.normalized(spark.createDataFrame([*rows, (17, bad), (150, bad)], "vec_id long, embedding array<double>").repartition(4))
        assert (e.value.lowest, e.value.bad) == (17, 2)
    assert sampling.normalized(df.limit(0)).count() == 0


@pytest.mark.parametrize(("k", "rows"), [(3, 1000), (3, 17), (10, 33), (30, 64)])
def test_thresholds_as_they_are_refreshed(spark, k, rows):
    rng = np.random.default_rng(k)
    v = rng.normal(size=(230, 4))
    v[200:] *= 0.01  # late rows that come near
    table = [(1000 - 3 * i, x.tolist()) for i, x in enumerate(v)] + [(5, None), (8, [float("nan")] * 4)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.0] * 4), (2, v[3].tolist()), (3, None)], "qid long, query array<double>")
    found = {(r["qid"], r["seen"]): r["threshold"] for r in thresholds.running(df, queries, k, rows=rows).collect()}
    order = [x for _, x in sorted(table)]
    refreshes = [n for n in range(1, len(order) + 1) if n >= k and (k <= 5 or (k <= 20 and n % 5 == 0) or (k > 20 and (n == k or n % 20 == 0)))]
    want = {}
    for qid, x in ((1, np.zeros(4)), (2, v[3])):
        last = None
        for n in refreshes:
            d = sorted(((np.array(e) - x) ** 2).sum() for e in order[:n] if e is not None and np.isfinite(e).all())
            if len(d) >= k and (last is None or d[k - 1] < last):
                want[qid, n] = last = d[k - 1]
    assert found.keys() == want.keys() and all(found[i] == pytest.approx(want[i]) for i in want)

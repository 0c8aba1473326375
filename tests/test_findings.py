"""Queries on tables that are larger, or of another shape, than the given ones."""

from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from velarium.functions import kernels
from velarium.operators import graph, hnsw, lockstep, schedule, search
from velarium.plans import ALL_QUERIES, surface


@pytest.fixture(scope="module")
def cloud(spark):
    """400 vectors of 64 dimensions, as a table and as an array."""
    v = np.random.default_rng(5).normal(size=(400, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), v.astype(np.float64)


def test_epochs_in_which_nobody_stands_out(spark, tmp_path):
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 10)
    e = spark.range(6000).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 3000).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") * 7919 % 6000 / 6).alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    found = ALL_QUERIES["epoch_sketches"](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in found) == 6000
    assert all(r["users_within"] and r["ranks_within"] and r["top_within"] for r in found)


@pytest.mark.parametrize("cell", [search._every(["fp32", "bits8"]), search._refinement([0, 16, 64])])
def test_pairs_leave_a_cell_in_runs(cell, monkeypatch, cloud):
    monkeypatch.setattr(search, "OUT", 1000)
    v, n = cloud[1], 0
    for run in cell(np.arange(50), v[:50], np.arange(400), v):
        assert len(run[0]) <= 1000
        assert np.abs(run[-1 if len(run) > 4 else 2] - ((v[run[0]] - v[run[1]]) ** 2).sum(axis=1)).max() < 1e-12
        n += len(run[0])
    assert n == 50 * 400


def test_leading_rows_are_the_first_sound_ones(spark):
    rows = [(i, [float(i), 0.0]) for i in range(9)] + [(9, [1.0]), (10, [2.0]), (11, [3.0])]
    odd = [(-3, None), (-2, [float("nan"), 0.0]), (-1, [None, 1.0]), (-4, [float("-inf"), 1.0])]
    base = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    assert sorted(r["vec_id"] for r in search.leading(base, 2).collect()) == [0, 1, 9, 10]


@pytest.mark.parametrize("name", ["fp32_fpma", "fp16_true", "fp8_fpma", "fp8_fpma_quantized", "fp8_fpma_quantized_e2m5", "fp8_fpma_quantized_e3m4", "int16_diff_fpma"])
def test_few_rows_are_looked_at_by_slow_distances(name, cloud, monkeypatch):
    kernel, v, looked = search.KERNELS[name], np.tile(cloud[1], (10, 1)) * (100 if name.startswith("int16") else 1), []
    v[400:] *= 1.5  # farther away, the same directions
    qid, ids, rows = np.arange(20), np.arange(4000) * 3, kernel.prepare(v)
    want = []
    for x in kernel.prepare(v[:20]):
        d = kernel.distances(x, rows)
        want.append((ids[search._first(d, 10)], np.sort(d)[:10]))
    distances = type(kernel).distances
    monkeypatch.setattr(type(kernel), "distances", lambda self, q, rows: looked.append(len(rows)) or distances(self, q, rows))
    found = [np.concatenate(c) for c in zip(*search._nearest_by(name, 10)(qid, v[:20], ids, v), strict=True)]
    assert np.array_equal(found[1], np.concatenate([w[0] for w in want])) and np.array_equal(found[2], np.concatenate([w[1] for w in want]))
    assert sum(looked) < 20 * 4000


def test_boundaries_over_several_ranges(spark, cloud, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 90)
    half = search.KERNELS["fp16_true"]
    log = search.boundaries(cloud[0], search.as_queries(cloud[0].where("vec_id % 100 = 0")), "fp16_true", "fp16_fpma", None, "qid long, c long, b long, be double, ce double, bo double, co double").collect()
    got = {(r["qid"], r["c"]): (r["b"], r["be"], r["ce"]) for r in log}
    assert len(got) == len(log) == 4 * 399
    for q in (0, 100, 200, 300):
        d = half.distances(half.prepare(cloud[1][q]), half.prepare(cloud[1]))
        for i in range(1, 400):
            b = int(d[:i].argmin())
            assert got[q, i] == (b, d[b], d[i])


def test_many_turns_go_on_at_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: made.append(1) or f(df))
    links = [(i, i // 2) for i in range(1, 200)]  # each start reaches nodes that are there already, or a node before
    edges = spark.createDataFrame(links, "src long, dst long")
    nodes = spark.range(200)
    found = {r["id"]: (r["turn"], r["hop"]) for r in graph.bfs(edges, 0, nodes).collect()}
    assert found == {i: (i, 0) for i in range(200)} and len(made) < 30


def test_a_query_meets_enough_of_a_table_without_clusters(spark):
    v = np.random.default_rng(8).normal(size=(3000, 48))
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index, q = graph.build(base, 8, rows=150), search.as_queries(base.where("vec_id % 100 = 0"))
    truth = search.knn(base, q, 10)
    assert index.parts >= 20
    assert search.recall(graph.search(index, q, 10), truth, 10).first()[0] >= 0.95
    assert search.recall(graph.search(index, q, 10, probe=2), truth, 10).first()[0] >= 0.4
    all_ = graph.search(index, q, 3, documents=7, ef=50).collect()
    d = {r["qid"]: ((v - v[r["qid"]]) ** 2).sum(axis=1) for r in all_}
    assert all(r["vec_id"] == min(range(r["doc_id"], 3000, 7), key=lambda i, q=r["qid"]: (d[q][i], i)) for r in all_) and len(all_) == 90


def depth_cell(monkeypatch):
    """What ``schedule.depths`` does in a cell: counts by query and depth."""
    kept = []
    monkeypatch.setattr(schedule, "in_cells", lambda base, queries, cell, *_, **__: kept.append(cell) or mock.MagicMock())
    schedule.depths(None, None, "reach")
    return lambda q, v, limits: {(i, b): n for run in kept[0](np.arange(len(q)), q, np.arange(len(v)), v, limits) for i, b, n in zip(*(x.tolist() for x in run), strict=True)}


def plain_depths(q, v, limits):
    want = {}
    for i, (x, limit) in enumerate(zip(q, limits, strict=True)):
        far = ((x - v) ** 2).sum(axis=1) > limit
        bounds = [kernels.bound(f"bits{b}") for b in range(6, 16)]
        beyond = np.array([b.distances(kernels.fp16(x), b.rows(v)) > limit for b in bounds] + [np.ones(len(v), bool)])
        for b, n in zip(*np.unique(np.where(far, 6 + beyond.argmax(axis=0), 16), return_counts=True), strict=True):
            want[i, int(b)] = int(n)
    return want


def test_few_pairs_are_summed_up_one_by_one_for_depths(spark, monkeypatch):
    v = np.random.default_rng(9).normal(size=(5000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q, looked = v[::50], []
    limits = np.array([np.partition(((x - v) ** 2).sum(axis=1), 9)[9] for x in q])
    want, cell = plain_depths(q, v, limits), depth_cell(monkeypatch)
    distances = kernels.Bound.distances
    monkeypatch.setattr(kernels.Bound, "distances", lambda self, x, rows: looked.append(len(rows[0])) or distances(self, x, rows))
    assert cell(q, v, limits) == want
    assert sum(looked) < len(q) * len(v) // 5


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("dim", [1, 7, 40])
def test_depths_of_odd_numbers(spark, monkeypatch, dim):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(600, dim)) * 10.0 ** rng.integers(-3, 2, size=(600, 1))
    v[0], v[1], v[2, 0], v[3, 0], v[4], v[5] = 0.0, -0.0, 65519.0, -65520.0, -1e-9, 1e200
    v[6], v[300:] = 3e-8, np.round(v[300:])  # many distances that equal each other
    v[100:120] = v[7]
    q = v[:40]
    limits = np.array([np.partition(((x - v) ** 2).sum(axis=1), 9)[9] for x in q])
    limits[20:24] = 0.0, np.nan, np.inf, 4.0
    assert depth_cell(monkeypatch)(q, v, limits) == plain_depths(q, v, limits)


def test_intervals_of_every_half():
    h = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float64)
    h = h[np.isfinite(h)]
    for bits in (6, 9, 16):
        low, high = kernels.intervals(h, bits)
        own = np.where(h == 0, 0.0, h).astype(np.float16).view(np.uint16) >> (16 - bits)
        for code in np.unique(own)[:: 1 if bits < 16 else 97]:
            at = own == code
            most = 0.0 if int(code) << (16 - bits) == 0x8000 else h[at].max()  # the interval of the least negative halves reaches to zero
            assert (low[at] == h[at].min()).all() and (high[at] == most).all()


def test_the_tenth_nearest_are_searched_once(spark, sf_dir):
    plan = surface._depths(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def test_a_task_has_one_cell(spark):
    base = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    cells = search.in_cells(base, search.as_queries(base.where("vec_id < 3")), lambda qid, q, ids, v: [[qid[:1], np.array([len(ids)])]], "qid long, n long", rows=100)
    found = cells.select("n", F.spark_partition_id().alias("task")).collect()
    assert len(found) == len({r["task"] for r in found}) == 20 and sum(r["n"] for r in found) == 2000


@pytest.fixture(scope="module")
def part():
    """A part of 1,500 vectors, built slot by slot, and the same graph as arrays."""
    v = np.random.default_rng(11).normal(size=(1500, 32))
    one = hnsw.Part(32, 8, 32)
    for i, x in enumerate(v):
        one.insert(i * 3, x, int(-np.log(((i * 7919) % 1499 + 1) / 1500) / np.log(8)))
    return one, lockstep.Flat.of(graph._table(0, one), 8)


@pytest.mark.parametrize(("ef", "stop", "queue", "bounds"), [(64, hnsw.Stop, None, None), (8, hnsw.Decoupled, None, None), (64, hnsw.Stop, (10, 10), lambda: hnsw.Bounds(10, 10)), (64, hnsw.Stop, (20, 10), lambda: hnsw.Bounds(20, 10, True))])
def test_searches_together_find_and_count_what_single_ones_do(part, ef, stop, queue, bounds):
    one, flat = part
    x = np.random.default_rng(12).normal(size=(60, 32))
    at, slot, d, counts = flat.search(x, 10, ef, queue)
    low = kernels.strict_bounds(one.vectors) if queue else None
    for i, y in enumerate(x):
        found, counted = one.search(y, stop(10, ef), None, low, bounds() if bounds else None)
        assert slot[at == i].tolist() == [s for _, s in found] and np.allclose(d[at == i], [far for far, _ in found])
        assert {c: int(n[i]) for c, n in counts.items()} == counted


def test_slots_added_together_make_a_sound_graph(part):
    one, _ = part
    flat = lockstep.built(np.arange(1500) * 3, one.vectors[:1500], np.array(one.level), 8, 32)
    x = np.random.default_rng(13).normal(size=(100, 32))
    truth = np.argsort(((flat.vectors - x[:, None]) ** 2).sum(axis=2), axis=1)[:, :10]
    share = lambda f: np.mean([np.isin(f[1][f[0] == i], truth[i]).sum() / 10 for i in range(100)])
    assert share(flat.search(x, 10, 64)) > share(part[1].search(x, 10, 64)) - 0.03
    again = hnsw.Part.of(flat.rows(), 8, 32)
    for s, own in enumerate(again.links):
        for level, near in enumerate(own):
            assert len(near) == len(set(near)) <= again._cap(level) and s not in near and all(again.level[j] >= level for j in near)
    copies = lockstep.built(np.arange(700), np.ones((700, 4)), np.arange(700) % 97 // 96, 8, 32)
    assert len(copies.search(np.ones((1, 4)), 10, 64)[1]) == 10 and len(lockstep.built(np.array([5]), np.ones((1, 4)), np.array([0]), 8, 32).search(np.ones((2, 4)), 10, 64)[0]) == 2


def test_parts_do_not_grow_with_the_table(spark):
    v = np.random.default_rng(14).normal(size=(6000, 64))
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index, q = graph.build(base, 8), search.as_queries(base.where("vec_id % 50 = 0"))
    assert index.state.groupBy("part").count().agg(F.max("count")).first()[0] < 1200
    assert search.recall(graph.search(index, q, 10), search.knn(base, q, 10), 10).first()[0] >= 0.97
    assert search.recall(graph.search(index, q, 10, ef=8), search.knn(base, q, 10), 10).first()[0] >= 0.6
    gone = graph.delete(index, base.where("vec_id % 50 = 0").select("vec_id"))  # searched one by one
    found = graph.search(gone, q, 3)
    assert found.count() == 360 and found.where("vec_id % 50 = 0").isEmpty()


def test_queries_are_sent_to_runs_of_parts(spark, cloud, monkeypatch):
    monkeypatch.setattr(graph, "RUNS", 3)
    index = graph.build(cloud[0], 8, rows=20)
    counted = graph.search_counted(index, search.as_queries(cloud[0].where("vec_id < 9")), 5).where("vec_id is null").select("part", "qid", F.spark_partition_id().alias("task")).collect()
    assert index.parts >= 20 and len({(r["part"], r["qid"]) for r in counted}) == len(counted) == 9 * index.parts
    assert len({r["task"] for r in counted}) <= 3 + 4


@pytest.mark.parametrize("scale", [1.0, 300.0, 3e4])
def test_few_rows_are_looked_at_for_boundaries(spark, monkeypatch, scale):
    """Of 3,000 rows over several ranges, with copies among them; larger components overflow half precision."""
    monkeypatch.setattr(search, "ROWS", 700)
    v = np.random.default_rng(15).normal(size=(3000, 24)).astype(np.float32)
    v *= np.float32(scale) / np.linalg.norm(v, axis=1, keepdims=True)
    v[1000:1010] = v[990]
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    half, kept = search.KERNELS["fp16_true"], []
    with np.errstate(over="ignore", invalid="ignore"):
        d, f = (np.array([k.distances(k.prepare(x), k.prepare(v.astype(float))) for x in v[::500].astype(float)]) for k in (half, search.KERNELS["fp16_fpma"]))
    log = search.boundaries(base, search.as_queries(base.where("vec_id % 500 = 0")), "fp16_true", "fp16_fpma", lambda n, i, a, b, c, bo, co: [np.array([n]), np.array([len(c)]), np.array([((c < b) != (co < bo)).sum()]), np.array([(c < b).sum()])], "qid long, n long, seen long, flip long, nearer long")
    for r in log.groupBy("qid").sum("n", "seen", "flip", "nearer").collect():
        e, g = d[r["qid"] // 500], f[r["qid"] // 500]
        at = np.array([e[:i].argmin() for i in range(1, 3000)])
        c, co = e[1:] < e[at], g[1:] < g[at]
        assert (r["sum(n)"], r["sum(flip)"], r["sum(nearer)"]) == (2999, (c != co).sum(), c.sum())
        kept.append(r["sum(seen)"])
    assert len(kept) == 6 and (scale > 1 or sum(kept) < 6 * 1500)


def test_two_kinds_of_squares_round_once(cloud, monkeypatch):
    v, (a, b) = kernels.fp16(cloud[1]), (kernels.KERNELS[n] for n in ("fp16_true", "fp16_fpma"))
    want = a.distances(v[3], v), b.distances(v[3], v)
    assert np.array_equal(want[0], kernels.fp16(kernels.fp16(v[3] - v) ** 2).sum(axis=1))
    monkeypatch.setattr(type(a), "distances", None)
    assert all(np.array_equal(x, y) for x, y in zip(want, kernels.distances_of_both(a, b, v[3], v, v[3], v), strict=True))


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(size=3000), rng.integers(-9999999, 9999999, 3000) / 2e6, rng.integers(-99, 99, 50) / 2e6, 10.0 ** rng.uniform(-12, 25, 500), [0.0, -0.0, -1e-9, 1.2345675, 5e-7, -5e-7, 4.9999999e-7, 2.0**-20, 1e300]])
    want = spark.createDataFrame([(float(y),) for y in x], "x double").select(F.round("x", 6).alias("r")).toPandas()["r"].to_numpy()
    assert np.array_equal(kernels.rounded(x), want) and not np.signbit(kernels.rounded(np.array([-0.0, -1e-9]))).any()
    assert np.isnan(kernels.rounded(np.array([np.nan]))[0]) and kernels.rounded(np.array([-np.inf]))[0] == -np.inf


def test_boundary_errors_are_rounded_in_their_cells(spark, sf_dir):
    plan = ALL_QUERIES["boundary_errors"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan

"""Formats, distances, bounds, joins, graphs, sources: against NumPy models and the hand-sized fixture."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from velarium.functions import bounds, numeric
from velarium.functions.distance import DISTANCES, distance, normalized, normalized_strict
from velarium.operators import analytics, graph, sampling, search
from velarium.sources import text
from velarium.sources.scratch import folder
from velarium.sources.vectors import register

BASE = [(i, [float(x) for x in v]) for i, v in enumerate([(2, 0, 0), (0, 3, 0), (0, 0, 4), (1, 1, 0), (-2, 0, 0), (0, -5, 0)])]
ASKED = [(i, [float(x) for x in v]) for i, v in enumerate([(7, 1, 0), (0, 2, 2), (-3, 0, 0), (1, -4, 0)])]
VECTORS = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def bundle(spark):
    base, q = spark.createDataFrame(BASE, VECTORS), spark.createDataFrame(ASKED, VECTORS)
    unit = lambda df: df.select("vec_id", normalized(F.col("embedding")).alias("embedding"))
    return unit(base), unit(q)


def plain(base, asked, k):
    n = lambda v: np.array(v) / np.linalg.norm(v)
    return {(q, r): i for q, x in asked for r, (_, i) in enumerate(sorted((round(float(((n(x) - n(v)) ** 2).sum()), 9), i) for i, v in base)[:k], 1)}


def test_bundle(spark, bundle):
    base, q = bundle
    picked = [r["vec_id"] for r in sampling.cyclic(q, "vec_id", 6).orderBy("position").collect()]
    assert picked == [0, 1, 2, 3, 0, 1]
    two = {(r["qid"], r["rank"]): r["vec_id"] for r in search.knn(base, search.as_queries(q), 2).collect()}
    assert two == plain(BASE, ASKED, 2)
    one = {(r["qid"], r["rank"]): r["vec_id"] for r in search.knn(base, search.as_queries(q), 1).collect()}
    assert one == {k: v for k, v in two.items() if k[1] == 1}
    fast = {(r["qid"], r["rank"]): r["vec_id"] for r in search.knn_blocked(base, search.as_queries(q), 2).collect()}
    assert fast == two
    norms = [r["n"] for r in base.select(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()]
    assert max(abs(n**0.5 - 1) for n in norms) < 2e-7
    again = sampling.cyclic(q, "vec_id", 6).select("position", F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    assert search.knn_distinct(base, again, 2).count() == 12


def test_zero_norm_is_rejected(spark):
    bad = spark.createDataFrame([*BASE, (6, [0.0, 0.0, 0.0])], VECTORS)
    with pytest.raises(Exception, match="row 6"):
        bad.select(normalized_strict(F.col("embedding"), F.col("vec_id"))).collect()


def model_square(bits: np.ndarray, table, shift: int) -> np.ndarray:
    """The approximate square on half-precision fields, as integers."""
    e, m = (bits >> 10) & 31, bits & 1023
    twice = 2 * m
    f = 2 * e - 15 + (twice >= 1024)
    r = twice % 1024 + np.array(table)[m >> shift]
    f, r = f + (r >= 1024), r % 1024
    out = np.where(f <= 0, 0, np.where(f >= 31, np.inf, np.ldexp(1 + r / 1024, np.clip(f, 0, 31) - 15)))
    return np.where(e == 0, 0, out)


@pytest.mark.parametrize(("table", "shift"), [(numeric.SQUARE_8, 7), (numeric.SQUARE_16, 6)])
def test_square_of_all_normal_encodings(spark, table, shift):
    bits = np.array([b for b in range(65536) if 1 <= (b >> 10) & 31 <= 30], np.int64)
    assert len(bits) == 61_440
    x = bits.astype(np.uint16).view(np.float16).astype(np.float64)
    df = spark.createDataFrame([(int(b), float(v)) for b, v in zip(bits, x)], "bits long, x double")
    got = {r["bits"]: r["s"] for r in df.select("bits", numeric.square_fp16(F.col("x"), table).alias("s")).collect()}
    assert all(got[int(b)] == w for b, w in zip(bits, model_square(bits, table, shift)))


def test_half_precision_is_ieee(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, s, 2000) for s in (1e-7, 1e-5, 1e-3, 1, 300)] + [[0.0, -0.0, 65504, 65519.9, 65520, -70000, 2.0**-24, 2.0**-25, 2.0**-14, 1.0]]).astype(np.float32)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    got = {r["i"]: r["y"] for r in df.select("i", numeric.fp16(F.col("x")).alias("y")).collect()}
    with np.errstate(over="ignore"):
        assert all(got[i] == float(np.float16(v)) for i, v in enumerate(x))


def test_eight_bit_formats(spark):
    rows = [(0.0, 0, 0, 0), (1.0625, 1.125, 1.0625, 1.0625), (500.0, 448, 6, 30), (-0.01, 0, 0, 0), (5.97, 6.0, 5.96875 + 0.03125, 6.0), (0.3, 0.3125, 0, 0.296875)]
    df = spark.createDataFrame([(float(r[0]),) for r in rows], "x double")
    out = df.select(numeric.fp8_e4m3(F.col("x")), numeric.fp8_e2m5(F.col("x")), numeric.fp8_e3m4(F.col("x"))).collect()
    for r, w in zip(out, rows):
        assert [float(v) for v in r] == pytest.approx([float(v) for v in w[1:]], abs=0.04)


@pytest.mark.parametrize("kind", list(numeric.FP8_FIELDS))
def test_eight_bit_codes_round_trip(spark, kind):
    wide, bits, _ = numeric.FP8_FIELDS[kind]
    codes = [c for c in range(256) if 0 < (c >> bits) % (1 << wide) < (1 << wide) - 1]
    df = spark.createDataFrame([(c,) for c in codes], "c int").withColumn("x", numeric.fp8_decode(F.col("c"), kind))
    assert df.where(numeric.fp8_encode(F.col("x"), kind) != F.col("c")).count() == 0


def test_every_distance_is_near_the_plain_one(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(v[i].tolist(), v[i + 10].tolist()) for i in range(10)], "a array<float>, b array<float>")
    plain_ = ((v[:10] - v[10:]) ** 2).sum(axis=1)
    loose = {"fp8_e2m5": 0.6, "fp8_e3m4": 0.35, "fp8_fpma_e2m5": 0.7, "fp8_fpma_e3m4": 0.4, "fp8_fpma_quantized": 0.3, "fp8_fpma_quantized_e2m5": 1.01, "fp8_fpma_quantized_e3m4": 1.01, "fp8_fpma": 0.15}
    for name in DISTANCES:
        if name in ("ip", "ip_negative", "l2_int", "int16_diff_fpma"):
            continue
        got = np.array([r[0] for r in df.select(distance(name, F.col("a"), F.col("b"))).collect()])
        assert np.abs(got / plain_ - 1).max() < loose.get(name, 0.06), name


def test_bounds_never_exceed_the_distance(spark):
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(200, 24)), rng.normal(size=(200, 24)) * rng.choice([1e-6, 0.1, 1, 30], size=(200, 24))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(q, v)], "q array<float>, v array<float>")
    exact = distance("fp32", F.col("q"), F.col("v"))
    halves = F.aggregate(F.zip_with(bounds.half(F.col("q")), bounds.half(F.col("v")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    checks = [(bounds.strict_lower_bound_l2(F.col("q"), F.col("v")), exact)] + [(bounds.lower_bound_bits(bounds.half(F.col("q")), bounds.intervals(F.col("v"), b)), halves) for b in (6, 8, 12, 16)]
    for low, high in checks:
        assert df.where(low > high + 1e-9).count() == 0
    r = df.select(*[bounds.lower_bound_bits(bounds.half(F.col("q")), bounds.intervals(F.col("v"), b)).alias(f"b{b}") for b in (6, 8, 12, 16)]).collect()
    assert all(x["b6"] <= x["b8"] + 1e-9 <= x["b12"] + 2e-9 <= x["b16"] + 3e-9 for x in r)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS).cache()


def answers(hits):
    return {(r["qid"], r["rank"]): r["vec_id"] for r in hits.collect()}


def test_pruning_keeps_the_exact_answers(cloud):
    q = search.as_queries(cloud.where("vec_id % 30 = 0"))
    want = answers(search.knn(cloud, q, 7))
    assert answers(search.filter_and_refine(cloud, q, 7)) == want == answers(search.knn_blocked(cloud, q, 7, rows=50))
    assert answers(search.knn(cloud, q, 3)) == {k: v for k, v in want.items() if k[1] <= 3}
    few = search.knn(cloud, q, 10, where=F.col("vec_id") % 50 == 0)
    assert few.count() == 10 * 6


def test_blocked_search_keeps_the_least_ids_of_equal_vectors(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(2000, 16)).astype(np.float32)
    v[::20] = v[0]
    v[1::50] = v[1]
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS).repartition(3)
    q = search.as_queries(base.where("vec_id in (0, 1, 7, 40)"))
    found = answers(search.knn_blocked(base, q, 10, rows=700))
    assert found == answers(search.knn(base, q, 10))
    assert [found[0, r] for r in range(1, 11)] == list(range(0, 200, 20))
    few = search.knn_blocked(base.where("vec_id < 6"), q, 10)
    assert answers(few) == answers(search.knn(base.where("vec_id < 6"), q, 10))


def test_bfs_goes_all_the_way_and_starts_again(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = [(i, i + 1) for i in range(70)] + [(i, 0) for i in (3, 5)] + [(200, 201), (201, 200), (201, 70), (90, 200)]
    edges = spark.createDataFrame(links, "src long, dst long").coalesce(1).cache()
    nodes = spark.createDataFrame([(i,) for i in [*range(71), 90, 200, 201, 300]], "id long").coalesce(1).cache()
    want, turn = {}, 0
    while left := {r["id"] for r in nodes.collect()} - set(want):
        front, hop = {min(left)}, 0
        while front:
            want |= {i: (turn, hop) for i in front}
            front, hop = {b for a, b in links if a in front} - set(want), hop + 1
        turn += 1
    degree = {a: sum(x == a for x, _ in links) for a, _ in links}
    all_ = graph.bfs_order(graph.bfs(edges, 0, nodes), edges).collect()
    assert {r["id"]: (r["turn"], r["hop"]) for r in all_} == want and len(all_) == len(want) == 75
    assert all(r["degree"] == degree.get(r["id"], 0) for r in all_)
    reached = graph.bfs_order(graph.bfs(edges, 0), edges)
    assert {r["id"]: r["hop"] for r in reached.collect()} == {i: i for i in range(71)} and reached.columns == ["id", "hop", "degree"]


def test_graph_search(spark, cloud):
    index = graph.build(cloud, 6, rows=150)
    assert index.parts >= 2
    q = search.as_queries(cloud.where("vec_id % 10 = 0"))
    truth = search.knn(cloud, q, 10)
    assert search.recall(graph.search(index, q, 10, ef=100), truth, 10).first()[0] >= 0.95
    assert answers(graph.search(index, q, 10, ef=300)) == answers(truth)
    assert search.recall(graph.search(index, q, 10, ef=100, dual_queue=True), truth, 10).first()[0] >= 0.8
    assert graph.search(index, q, 10, ef=4).count() == 10 * 30
    counts = graph.counters(graph.search_counted(index, q, 10, ef=30)).collect()
    assert len(counts) == 30 and all(r["distances"] >= r["hops"] > 0 for r in counts)
    even = cloud.where("vec_id % 2 = 0")
    assert answers(graph.search(index, q, 10, ef=300, admit=even.select("vec_id"))) == answers(search.knn(even, q, 10))
    near = graph.search(index, q, 300, ef=64, radius=20.0, least=3)
    want = search.range_search(cloud, q, 20.0, least=3)
    pairs = lambda hits: {(r["qid"], r["vec_id"]) for r in hits.collect()}
    assert len(pairs(near) & pairs(want)) >= 0.97 * max(len(pairs(want)), len(pairs(near)))
    docs = graph.search(index, q, 4, ef=40, documents=40).collect()
    exact = search.knn_multivector(cloud.withColumn("doc", F.col("vec_id") % 40), q, 4, "doc").collect()
    assert {(r["qid"], r["rank"], r["vec_id"]) for r in docs} == {(r["qid"], r["rank"], r["vec_id"]) for r in exact}
    assert graph.census(index).first()[1:] == (0, 0, 0, 0)


def test_graph_updates(spark, cloud, tmp_path):
    index = graph.build(cloud.where("vec_id < 200"), 6, rows=100)
    index = graph.insert(index, cloud.where("vec_id >= 200"))
    q = search.as_queries(cloud.where("vec_id % 10 = 0"))
    assert answers(graph.search(index, q, 10, ef=300)) == answers(search.knn(cloud, q, 10))
    moved = cloud.withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding")))
    index = graph.insert(index, moved.where("vec_id % 9 = 0"))
    assert search.recall(graph.search(index, q, 10, ef=300), search.knn(moved, q, 10), 10).first()[0] >= 0.99
    gone = spark.createDataFrame([(i,) for i in range(0, 300, 7)], "vec_id long")
    index = graph.delete(index, gone)
    left = moved.join(gone, "vec_id", "left_anti")
    assert search.recall(graph.search(index, q, 10, ef=300), search.knn(left, q, 10), 10).first()[0] >= 0.99
    assert graph.search(index, q, 300, ef=300).join(gone, "vec_id", "left_semi").count() == 0
    back = graph.undelete(index, gone.where("vec_id < 100"))
    assert back.state.where("deleted").count() == gone.where("vec_id >= 100").count()
    fresh = spark.createDataFrame([(1000 + i, [float(i)] * 16) for i in range(8)], VECTORS)
    reused = graph.insert(index, fresh, reuse=True)
    assert reused.state.count() < index.state.count() + 8 and reused.state.where("id >= 1000").count() == 8
    assert graph.census(reused).first()[1:] == (0, 0, 0, 0)
    for ids, work, problem in ((gone, graph.delete, "already deleted"), (fresh, graph.delete, "unknown"), (cloud.where("vec_id = 1"), graph.undelete, "not deleted")):
        with pytest.raises(Exception, match=problem):
            work(index, ids.select("vec_id"))
    at = str(tmp_path / "index")
    graph.save(index, at)
    again = graph.load(spark, at)
    assert answers(graph.search(again, q, 10)) == answers(graph.search(index, q, 10))
    head = graph.inspect(spark, at).first()
    assert (head["rows"], head["dim"], head["deleted"]) == (300, 16, gone.count()) and head["bytes"] > 0


def test_kernels_equal_the_columns(spark):
    rng = np.random.default_rng(3)
    edge = [0.0, -0.0, 1.0, 6.1e-5, 6.0e-8, 2.0**-14, 65504.0, 65519.0, 65520.0, 1e-3, 0.499999, 448.0, 30.0, 6.0, 0.125, 0.5, 2.0**-6, -2.5, 3.5, 1023.5]
    v = np.concatenate([rng.normal(size=(40, 20)), rng.normal(size=(20, 20)) * 50, [edge]]).astype(np.float32)
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS)
    q = search.as_queries(base.where("vec_id % 10 = 0"))
    for name in DISTANCES:
        want = {(r["qid"], r["vec_id"]): r["d"] for r in search.distances(base, q, name).collect()}
        got = {(r["qid"], r["vec_id"]): r["d0"] for r in search.pair_distances(base, q, [name]).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == want[k] or (got[k] != got[k] and want[k] != want[k]) or abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])), (name, k, got[k], want[k])


def test_product_table():
    table = numeric.product_table()
    # The first two rows and the last one.
    assert table[0] == [1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23, 25, 27, 27, 13]
    assert table[1] == [3, 9, 15, 21, 27, 33, 39, 45, 51, 57, 63, 69, 74, 68, 44, 15]
    assert table[15] == [13, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 0]


def test_kmeans_and_capacity(cloud):
    centers = sampling.kmeans(cloud, 4, rounds=2)
    assert centers.shape == (4, 16)
    assert np.allclose(centers, sampling.centroids(cloud, 4, 10_000, rounds=2))
    a = sampling.balanced(sampling.assign(cloud, centers), 50)
    assert a.where("not overflow").groupBy("cluster").count().where("count > 50").count() == 0 and a.count() == 300


def test_lru(spark):
    rows = [(1, n, x) for n, x in enumerate([1, 2, 1, 3, 2, 1, 1, 4, 5, 1])]
    out = sampling.lru_hits(spark.createDataFrame(rows, "k long, t long, x long"), "k", ["t"], "x", 2).first()
    seen, hits = [], 0
    for _, _, x in rows:
        hits += x in seen
        seen = ([y for y in seen if y != x] + [x])[-2:]
    assert (out["accesses"], out["hits"]) == (10, hits)


@pytest.mark.parametrize("layout", ["fbin", "FVECS"])
def test_vector_files(spark, layout, tmp_path):
    register(spark)
    at = folder(spark)
    df = spark.createDataFrame([(i, [float(i), i / 2]) for i in range(1000)], VECTORS)
    df.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id").write.format("vectors").mode("append").option("layout", layout).save(at)
    back = spark.read.format("vectors").option("layout", layout).option("rows", 100).load(at)
    assert back.rdd.getNumPartitions() >= 10
    assert [tuple(r) for r in back.orderBy("vec_id").collect()] == [tuple(r) for r in df.orderBy("vec_id").collect()]


def test_bad_vector_files_fail(spark, tmp_path):
    register(spark)
    cases = {"short.fbin": struct.pack("<ii3f", 2, 2, 1, 2, 3), "long.fbin": struct.pack("<ii5f", 2, 2, 1, 2, 3, 4, 5), "zero.fbin": struct.pack("<ii", 0, 0), "mixed.fvecs": struct.pack("<i2fi2f", 2, 1, 2, 3, 1, 2), "cut.fvecs": struct.pack("<i2fi", 2, 1, 2, 2)}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception):
            spark.read.format("vectors").option("layout", name.split(".")[1]).load(f"file://{tmp_path}/{name}").collect()


def test_text_inputs(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("a: 1\n  ef_search: 80  # note\nef_search: 90\n")
    row = text.settings(spark, f"file://{tmp_path}/c.yaml", ["ef_search", "nothing"]).first()
    assert (row["ef_search"], row["nothing"]) == ("80", None)
    (tmp_path / "t.tsv").write_text("x\ty\n1\t2.5\n")
    assert text.delimited(spark, f"file://{tmp_path}/t.tsv", "x int, y double").first() == (1, 2.5)
    with pytest.raises(Exception):
        text.delimited(spark, f"file://{tmp_path}/t.tsv", "x int, z double").collect()
    lines = spark.createDataFrame([("LD 0xff",), ("ST 12",)], "value string")
    assert [tuple(r) for r in text.load_store_trace(lines).collect()] == [("LD", 255), ("ST", 12)]
    with pytest.raises(Exception):
        text.load_store_trace(spark.createDataFrame([("XX 1",)], "value string")).collect()
    rw = text.read_write_trace(spark.createDataFrame([("R 1,2,3",)], "value string")).first()
    assert (rw["op"], rw["addr_vec"]) == ("R", [1, 2, 3])
    logs = text.log_rows(spark.createDataFrame([("L time qps recall",), ("10 0.5 1234.5 0.91",)], "value string")).collect()
    assert [tuple(r) for r in logs] == [(10, 0.5, 1234.5, 0.91)]
    text.write_metadata(spark, {"rows": 6, "dimension": 3}, f"file://{tmp_path}/meta")
    assert text.read_metadata(spark, f"file://{tmp_path}/meta") == {"rows": "6", "dimension": "3"}
    lines = text.markdown(spark.createDataFrame([(i, None if i else "x | y\nz") for i in range(500)], "a int, b string"), ["a"]).orderBy("line").collect()
    assert [r["value"] for r in lines[:4]] == ["| a | b |", "| --- | --- |", "| 0 | x \\| y z |", "| 1 |  |"] and len(lines) == 502
    kept, dropped = text.capped(spark.range(10), ["id"], 4)
    assert kept.count() == 4 and dropped.first()[0] == 6


def test_geomean_needs_positive_values(spark):
    assert spark.createDataFrame([(1.0,), (4.0,)], "x double").agg(analytics.geomean(F.col("x"))).first()[0] == pytest.approx(2)
    with pytest.raises(Exception, match="positive"):
        spark.createDataFrame([(0.0,)], "x double").agg(analytics.geomean(F.col("x"))).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_name_and_most_have_an_oracle():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    own = {k for k in known if not k.startswith(("op", "pipeline"))}
    assert own - set(entry.oracle_sql()) == {"graph_build", "graph_search", "graph_search_et", "pruned_counters"}


def test_medians_and_percentiles_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(analytics, "RUN", 40)
    rng = np.random.default_rng(6)
    rows = [(int(k) if k < 3 else None, float(x) if x > 2 else None) for k, x in zip(rng.integers(0, 4, 900), np.round(rng.gamma(2, 20, 900)), strict=True)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(3)
    groups = {k: sorted(x for g, x in rows if g == k and x is not None) for k in (0, 1, 2, None)}
    assert {r["k"]: (r["median"], r["n"]) for r in analytics.median_of(df, ["k"], "x").collect()} == {k: (float(np.median(v)), len(v)) for k, v in groups.items()}
    got = {r["k"]: (r["low"], r["high"]) for r in analytics.percentile_of(df, ["k"], "x", {"low": 0.05, "high": 0.95}).collect()}
    least = lambda v, q: next(x for n, x in enumerate(v, 1) if n / len(v) >= q)
    assert got == {k: (least(v, 0.05), least(v, 0.95)) for k, v in groups.items()}

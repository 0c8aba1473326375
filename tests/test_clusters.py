"""Radius joins, cells with odd vectors, places in order, balanced clusters and partitions, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from velarium.operators import clustering, graph, partition, radius, sampling, search

VECTORS = "vec_id long, embedding array<double>"


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(v)], VECTORS)


def groups(n=12, each=60, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n, dim)) * 20
    return np.concatenate([c + rng.normal(size=(each, dim)) * 0.4 for c in centers])


def pairs(df):
    return {(r["qid"], r["vec_id"]): r["d"] for r in df.collect()}


def plain_within(q, v, squared):
    d = ((q[:, None] - v[None]) ** 2).sum(axis=2)
    return {(int(i), int(j)): d[i, j] for i, j in np.argwhere(d <= squared)}


@pytest.mark.parametrize("squared", [0.0, 0.5, 3.0, 5000.0])
def test_radius_join(spark, squared):
    v = groups()
    base = table(spark, v)
    cells = radius.Cells(base, 12, 25)
    queries = search.as_queries(base.where("vec_id % 7 = 0"))
    found = pairs(radius.within(base, queries, squared, cells, asked=40))
    want = {(i, j): d for (i, j), d in plain_within(v, v, squared).items() if i % 7 == 0}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    cost = cells.cost(queries, float(np.sqrt(squared))).first()
    assert cost["all"] == len(v) * queries.count() and len(want) <= cost["met"]
    if squared <= 3:
        assert cost["met"] <= cost["all"] / 8  # of twelve groups a ball meets about one


def test_radius_join_over_equal_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(900, None), (901, [1.0, None]), (902, [1.0, float("nan")]), (903, [float("inf"), 1.0]), (904, [1.0]), (905, []), (906, [1.0, 2.5])]
    base = spark.createDataFrame(rows, VECTORS)
    cells = radius.Cells(base, 4, 50)
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [9.0, 9.0])], "qid long, query array<double>")
    found = pairs(radius.within(base, queries, 0.3, cells, asked=2))
    assert found.keys() == {(1, i) for i in [*range(300), 906]}
    assert not pairs(radius.within(base.limit(0), queries, 1.0)) and not pairs(radius.within(base, queries.limit(0), 1.0))


def test_range_search_least_and_most(spark):
    v = groups(4, 20)
    base = table(spark, v)
    far = spark.createDataFrame([(500, [1000.0] * 6)], "qid long, query array<double>")
    queries = search.as_queries(base.where("vec_id % 10 = 0")).unionByName(far)
    rows = search.range_search(base, queries, 2.0, least=3, most=5).collect()
    q = {r["qid"]: np.array(r["query"]) for r in queries.collect()}
    for qid, x in q.items():
        d = ((v - x) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(len(v)), d))[:5]
        want = [(k + 1, int(j)) for k, j in enumerate(order) if d[j] <= 2.0 or k < 3]
        assert sorted((r["rank"], r["vec_id"]) for r in rows if r["qid"] == qid) == want


def test_cells_leave_out_unsound_vectors(spark):
    rows = [(0, [0.0, 0.0]), (1, [0.0, None]), (2, [1.0, 0.0]), (3, [float("nan"), 0.0]), (4, [1.0]), (5, [3.0]), (6, None), (7, [2.0, 0.0])]
    base = spark.createDataFrame(rows, VECTORS)
    queries = spark.createDataFrame([(10, [0.0, 0.0]), (11, [2.9]), (12, [None, 0.0])], "qid long, query array<double>")
    found = {(r["qid"], r["rank"]): (r["vec_id"], r["d"]) for r in search.knn(base, queries, 3).collect()}
    assert found == {(10, 1): (0, 0.0), (10, 2): (2, 1.0), (10, 3): (7, 4.0), (11, 1): (5, pytest.approx(0.01)), (11, 2): (4, pytest.approx(3.61))}
    near = {r["vec_id"]: r["cluster"] for r in sampling.assign(base, np.array([[0.0, 0.0], [2.0, 0.0]])).collect()}
    assert near == {0: 0, 2: 0, 7: 1}


def test_documents_in_cells(spark):
    v = groups(5, 30)
    base = table(spark, v).withColumn("doc", F.when(F.col("vec_id") != 3, F.col("vec_id") % 11))
    queries = search.as_queries(base.where("vec_id % 13 = 0"))
    found = {(r["qid"], r["rank"]): (r["doc_id"], r["vec_id"]) for r in search.knn_multivector(base, queries, 4, "doc").collect()}
    for qid in range(0, len(v), 13):
        d = ((v - v[qid]) ** 2).sum(axis=1)
        best = sorted((min((d[i], i) for i in range(c, len(v), 11) if i != 3), c) for c in range(11))[:4]
        assert [found[qid, k] for k in range(1, 5)] == [(c, i) for (_, i), c in best]


def test_positions(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RUN", 40)
    rng = np.random.default_rng(2)
    rows = [(i, None if g == 0 else int(g), float(x)) for i, (g, x) in enumerate(zip(rng.choice([0, 1, 1, 1, 2], 500), rng.integers(0, 9, 500), strict=True))]
    df = spark.createDataFrame(rows, "id long, g long, x double")
    for by in ([], ["g"]):
        got = {r["id"]: r["n"] for r in sampling.positions(df, ["x", "id"], by, "n").collect()}
        for group in {r[1] for r in rows} if by else {0}:
            own = sorted((x, i) for i, g, x in rows if not by or g == group)
            assert all(got[i] == n for n, (_, i) in enumerate(own))
    assert sampling.positions(df.limit(0), ["x"], ["g"]).count() == 0


def plain_proposals(v, centers, capacity):
    d = ((v[:, None] - centers[None]) ** 2).sum(axis=2)
    choices = [list(np.lexsort((np.arange(len(centers)), row))) for row in d]
    free, kept = list(range(len(v))), {c: [] for c in range(len(centers))}
    while free:
        i = free.pop()
        if choices[i]:
            c = choices[i].pop(0)
            kept[c] = sorted([*kept[c], i], key=lambda j: (d[j, c], j))
            free += kept[c][capacity:]
            kept[c] = kept[c][:capacity]
    return {i: (c, n) for c, own in kept.items() for n, i in enumerate(own)}


@pytest.mark.parametrize(("capacity", "placed"), [(50, 150), (70, 150), (30, 120)])
def test_capacities(spark, monkeypatch, capacity, placed):
    monkeypatch.setattr(sampling, "RUN", 60)
    v = groups(3, 50, seed=4)
    v[100:] = v[:50] + 0.01  # one group twice as large
    centers = v[[0, 55, 60, 70]]
    found = clustering.capacity_assigned(table(spark, v), centers, capacity).collect()
    assert len(found) == len(v) and sum(r["cluster"] is not None for r in found) == placed
    assert {r["vec_id"]: (r["cluster"], r["slot"]) for r in found if r["cluster"] is not None} == plain_proposals(v, centers, capacity)


def test_seeds_and_means(spark):
    v = groups(7, 30, seed=5)
    base = table(spark, v)
    assert np.array_equal(clustering.farthest_seeds(base, 7), v[sampling.farthest_first(v, 7)])
    for seeds in (clustering.farthest_seeds(base, 7), clustering.oversampled_seeds(base, 7)):
        centers = clustering.means(base, seeds, 3)
        own = ((v[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert sorted(np.bincount(own, minlength=7)) == [30] * 7
    sizes = clustering.balanced_kmeans(base, 4, 2, seeding="oversampled").groupBy("cluster").count().collect()
    assert all(r["count"] <= 53 for r in sizes) and sum(r["count"] for r in sizes) == 210
    few = table(spark, [[1.0, 1.0]] * 5)
    assert len(clustering.farthest_seeds(few, 3)) == 1 and len(clustering.oversampled_seeds(few, 3)) == 1


def test_partition_finds_communities(spark):
    rng = np.random.default_rng(6)
    edges = [(20 * g + int(a), 20 * g + int(b)) for g in range(4) for a, b in rng.integers(0, 20, (150, 2))] + [(0, 20), (21, 40), (41, 60), (5, 5), (3, 999)]
    nodes = spark.range(83).withColumnRenamed("id", "node")  # three nodes have no edge
    links = spark.createDataFrame(edges, "src long, dst long")
    found = {r["node"]: r for r in partition.partition(nodes, links, 4, 5).collect()}
    part = {n: r["part"] for n, r in found.items()}
    assert set(found) == set(range(83)) and max(np.bincount(list(part.values()), minlength=4)) <= 21
    real = {tuple(sorted(e)) for e in edges if e[0] != e[1] and 999 not in e}
    assert {r["cut"] for r in found.values()} == {sum(part[a] != part[b] for a, b in real)}
    dealt = sampling.place(nodes, "node", 4, "modulo").collect()
    modulo = {r["node"]: r["part"] for r in dealt}
    assert next(iter(found.values()))["cut"] < sum(modulo[a] != modulo[b] for a, b in real) / 3


def test_partition_without_edges(spark):
    nodes = spark.range(10).withColumnRenamed("id", "node")
    none = spark.createDataFrame([], "src long, dst long")
    rows = partition.partition(nodes, none, 3).collect()
    assert sorted(np.bincount([r["part"] for r in rows])) == [2, 4, 4] and {r["cut"] for r in rows} == {0}
    assert partition.partition(nodes.limit(0), none, 3).count() == 0


def test_parts_split_as_an_index_grows(spark):
    v = groups(4, 80, seed=8)
    base = table(spark, v)
    index = graph.build(base.where("vec_id < 60"), 6, 24, rows=40)
    before = index.parts
    index = graph.delete(index, base.where("vec_id < 10").select("vec_id"))
    index = graph.insert(index, base.where("vec_id >= 60"), size=30)
    sizes = [r["count"] for r in index.state.groupBy("part").count().collect()]
    assert index.parts > before and len(sizes) <= index.parts and max(sizes) <= 60 and sum(sizes) == len(v)
    assert {r["id"] for r in index.state.where("deleted").collect()} == set(range(10))
    faults = graph.census(index).first().asDict()
    assert faults.pop("nodes") == len(v) and not any(faults.values())
    hits = graph.search(index, search.as_queries(base.where("vec_id % 9 = 0")), 5)
    truth = search.knn(base.where("vec_id >= 10"), search.as_queries(base.where("vec_id % 9 = 0")), 5)
    assert search.recall(hits, truth, 5).first()[0] >= 0.95
    assert graph.rebalanced(index, 30).first == index.first

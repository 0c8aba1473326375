"""Graph queries on the nearest-neighbour graph of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, search
from ..sources.scratch import cut, folder
from . import sqlnum as s
from .vectors import K, asked, out, vectors

QUERIES, ORACLES = {}, {}
M = 8


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def knn_edges(spark, sf_dir) -> DataFrame:
    """level, src, dst: each node's 8 nearest others."""
    base = vectors(spark, sf_dir)
    near = search.knn_blocked(base, search.as_queries(base), M + 1).where("qid <> vec_id")
    return search.ranked(near.drop("rank"), M).select(F.lit(0).alias("level"), F.col("qid").alias("src"), F.col("vec_id").alias("dst"))


EDGES = f"SELECT qid AS src, vec_id AS dst FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS k FROM ({s.all_pairs('fp32', where='q.vec_id <> v.vec_id')})) WHERE k <= 8"


_saved: dict[tuple[str, str], str] = {}


def saved_index(spark, sf_dir) -> graph.Index:
    """The index of the embeddings: built and saved at a session's first use, loaded from then on."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _saved:
        at = folder(spark)
        graph.save(graph.build(vectors(spark, sf_dir), M), at)
        _saved[key] = at
    return graph.load(spark, _saved[key])


@query()
def graph_build(spark, sf_dir):
    """Links of the layered graph, built anew."""
    return graph.edges_of(graph.build(vectors(spark, sf_dir), M))


@query()
def graph_search(spark, sf_dir):
    return out(graph.search(saved_index(spark, sf_dir), asked(vectors(spark, sf_dir)), 10))


@query()
def graph_search_et(spark, sf_dir):
    """The search with dual-queue early termination."""
    return out(graph.search(saved_index(spark, sf_dir), asked(vectors(spark, sf_dir)), 10, dual_queue=True))


#: Searches of the saved index, and the least recall that each has to reach.
SEARCHES = {"plain": (0.95, {}), "decoupled": (0.6, {"ef": 8}), "dual queue": (0.8, {"dual_queue": True}), "batched queue": (0.9, {"dual_queue": (20, 10)}), "two cells": (0.4, {"probe": 2})}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in SEARCHES) + ") v(search, reached), (SELECT count(*) AS queries FROM embeddings WHERE vec_id % 25 = 0)")
def graph_recall(spark, sf_dir):
    """Whether each kind of graph search finds enough of the exact answer.

    The floors below 0.9 belong to searches that give recall up by their
    definition: ``decoupled`` keeps 8 candidates for 10 answers (0.8 at best),
    ``dual queue`` prunes by bounds of what it has kept so far, and ``two
    cells`` looks at two cells however many there are.
    """
    index, base = saved_index(spark, sf_dir), vectors(spark, sf_dir)
    truth, found = cut(search.knn(base, asked(base), K)), None
    for name, (least, how) in SEARCHES.items():
        hits = search.hits_at(graph.search(index, asked(base), K, **how), truth, K)
        r = hits.agg(F.count("*").alias("queries"), (F.sum("hits") >= least * K * F.count("*")).alias("reached")).select(F.lit(name).alias("search"), "reached", "queries")
        found = r if found is None else found.unionByName(r)
    return found


@query("SELECT count(*) AS queries, true AS fewer_distances, true AS counted FROM embeddings WHERE vec_id % 25 = 0")
def graph_counters(spark, sf_dir):
    """Work of the searches: the second queue saves distances, and every query is counted."""
    index, q = saved_index(spark, sf_dir), asked(vectors(spark, sf_dir))
    plain, early = (graph.counters(graph.search_counted(index, q, K, dual_queue=d)) for d in (False, True))
    both = plain.join(early.select("qid", F.col("distances").alias("fewer"), "pruned"), "qid")
    return both.agg(F.count("*").alias("queries"), (F.sum("fewer") <= F.sum("distances")).alias("fewer_distances"), F.min((F.col("hops") > 0) & (F.col("distances") >= F.col("hops"))).alias("counted"))


EXACT_DOCUMENTS = f"SELECT qid, rank::INTEGER AS rank, doc_id, vec_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM (SELECT qid, vec_id % 20 AS doc_id, min(d) AS d, arg_min(vec_id, (d, vec_id)) AS vec_id FROM ({s.all_pairs('fp32')}) GROUP BY qid, vec_id % 20)) WHERE rank <= 5"


@query(EXACT_DOCUMENTS)
def graph_documents(spark, sf_dir):
    """The nearest documents through the graph; with as many kept as there are, the search is exact."""
    hits = graph.search(saved_index(spark, sf_dir), asked(vectors(spark, sf_dir)), 5, documents=20, ef=400)
    return hits.select("qid", F.col("rank").cast("int").alias("rank"), "doc_id", "vec_id", F.round("d", 6).alias("d"))


@query("SELECT count(*) AS nodes, 0::BIGINT AS self_loops, 0::BIGINT AS repeated, 0::BIGINT AS overfull, 0::BIGINT AS astray FROM embeddings")
def graph_built_integrity(spark, sf_dir):
    """The saved graph's nodes, and its faults of each kind."""
    return graph.census(saved_index(spark, sf_dir))


@query(
    "SELECT vec_id, vec_id % 7 = 0 AND vec_id % 14 <> 0 AS deleted, round(CASE WHEN vec_id % 11 = 0 THEN -1 ELSE 1 END * list_sum(embedding)::DOUBLE, 3) + 0.0 AS total FROM "
    "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)"
)
def graph_updates(spark, sf_dir):
    """Ids, marks and vectors after a build on half the rows, an insert of the others, moves, deletions and their withdrawal."""
    base = vectors(spark, sf_dir)
    named = lambda n: base.where(F.col("vec_id") % n == 0).select("vec_id")
    index = graph.insert(graph.build(base.where("vec_id % 2 = 0"), M), base.where("vec_id % 2 = 1"))
    index = graph.insert(index, base.where("vec_id % 11 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    index = graph.undelete(graph.delete(index, named(7)), named(14))
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x)
    return index.state.select(F.col("id").alias("vec_id"), "deleted", (F.round(total, 3) + 0.0).alias("total"))


LEVELS = "SELECT vec_id AS id, floor(-ln((('0x' || substr(md5(vec_id || ':100'), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE) / ln(8))::INTEGER AS level FROM embeddings"


@query(f"SELECT level, count(*) AS n FROM ({LEVELS}) GROUP BY level")
def graph_level_census(spark, sf_dir):
    """Levels of the saved index's nodes."""
    return graph.nodes_of(saved_index(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


def _shared_sql(level: int) -> str:
    """Links of a level among its own nodes: those that are among each other's 8 nearest."""
    own = f"(SELECT id FROM ({LEVELS}) WHERE level >= {level})"
    near = f"SELECT qid, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS k FROM ({s.all_pairs('fp32', where=f'q.vec_id <> v.vec_id AND q.vec_id IN {own} AND v.vec_id IN {own}')})) WHERE k <= 8"
    return f"SELECT {level} AS level, a.qid AS id, count(*) AS degree FROM ({near}) a JOIN ({near}) b ON a.qid = b.vec_id AND a.vec_id = b.qid GROUP BY a.qid"


@query(f"SELECT n.id, n.level, coalesce(degree, 0)::BIGINT AS degree FROM ({LEVELS}) n LEFT JOIN ({' UNION ALL '.join(_shared_sql(l) for l in (1, 2, 3, 4))}) e USING (id, level) WHERE n.level >= 1 ORDER BY n.level DESC, coalesce(degree, 0) DESC, n.id LIMIT 20")
def hot_nodes(spark, sf_dir):
    """The 20 hottest nodes, the highest levels first and by links inside a level, where mutual neighbours are linked."""
    base = vectors(spark, sf_dir)
    nodes = graph.levels(base, M)
    edges = None
    for level in (1, 2, 3, 4):
        own = base.join(nodes.where(F.col("level") >= level).select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
        near = search.knn(own, search.as_queries(own), M + 1).where("qid <> vec_id")
        near = search.ranked(near.drop("rank"), M).select(F.lit(level).alias("level"), F.col("qid").alias("src"), F.col("vec_id").alias("dst"))
        shared = near.join(near.select("level", F.col("dst").alias("src"), F.col("src").alias("dst")), ["level", "src", "dst"])
        edges = shared if edges is None else edges.unionByName(shared)
    return graph.hot(nodes, edges, 20)


@query(f"SELECT 0 AS level, vec_id AS id, 'no inbound link' AS problem FROM embeddings WHERE vec_id NOT IN (SELECT dst FROM ({EDGES}))")
def graph_integrity(spark, sf_dir):
    nodes = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"))
    return graph.integrity(nodes, knn_edges(spark, sf_dir))


@query(f"SELECT 0 AS level, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT dst, count(*) AS n FROM ({EDGES}) GROUP BY dst)")
def graph_degree_stats(spark, sf_dir):
    return graph.degree_stats(knn_edges(spark, sf_dir))


@query(
    f"WITH RECURSIVE e AS MATERIALIZED ({EDGES}), r(id, hop) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.id WHERE r.hop < (SELECT count(*) FROM embeddings)), "
    "f AS (SELECT id, min(hop)::INTEGER AS hop FROM r GROUP BY id) "
    "SELECT vec_id AS id, hop IS NOT NULL AS reached, coalesce(hop, -1)::INTEGER AS hop, (SELECT count(*) FROM e WHERE src = vec_id) AS degree FROM embeddings LEFT JOIN f ON f.id = vec_id"
)
def graph_bfs_order(spark, sf_dir):
    """All nodes: hops of those that node 0 reaches, -1 of the others, at which the traversal starts again."""
    edges, nodes = cut(knn_edges(spark, sf_dir)), vectors(spark, sf_dir).select(F.col("vec_id").alias("id"))
    order = graph.bfs_order(graph.bfs(edges, 0, nodes), edges)
    return order.select("id", (F.col("turn") == 0).alias("reached"), F.when(F.col("turn") == 0, F.col("hop")).otherwise(-1).alias("hop"), "degree")


#: Every visit: hop by hop from node 0, then again from the least node not visited; a step carries all visits so far.
VISITS = (
    f"e AS MATERIALIZED ({EDGES}), r(step, id, turn, hop) AS (SELECT 0, 0::BIGINT, 0, 0 UNION ALL SELECT x.step + 1, y.id, y.turn, y.hop FROM (SELECT max(step) AS step, max(turn) AS turn, max(hop) FILTER (turn = t) AS hop FROM r, (SELECT max(turn) AS t FROM r)) x, "
    "LATERAL (SELECT r.id, r.turn, r.hop FROM r UNION ALL SELECT n.id, x.turn, x.hop + 1 FROM (SELECT DISTINCT e.dst AS id FROM r JOIN e ON e.src = r.id WHERE e.dst NOT IN (SELECT id FROM r)) n "
    "UNION ALL SELECT m.id, x.turn + 1, 0 FROM (SELECT min(vec_id) AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM r)) m WHERE m.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r JOIN e ON e.src = r.id WHERE e.dst NOT IN (SELECT id FROM r))) y "
    "WHERE (SELECT count(*) FROM r) < (SELECT count(*) FROM embeddings))"
)


@query(
    f"WITH RECURSIVE {VISITS}, g AS (SELECT dst AS id, count(*) AS degree FROM e GROUP BY dst) "
    "SELECT r.id, row_number() OVER (ORDER BY turn, hop, coalesce(degree, 0) DESC, r.id) - 1 AS slot FROM r LEFT JOIN g ON g.id = r.id WHERE step = (SELECT max(step) FROM r)"
)
def slot_reorder(spark, sf_dir):
    """Storage slots of all nodes: by the traversal's turn and hop, then by inbound links, then by id."""
    edges, nodes = cut(knn_edges(spark, sf_dir)), vectors(spark, sf_dir).select(F.col("vec_id").alias("id"))
    inbound = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.slots(graph.bfs_order(graph.bfs(edges, 0, nodes), inbound))


@query("SELECT 'velarium-graph-1' AS format, 8 AS m, count(*) AS rows, max(len(embedding))::INTEGER AS dim, min(vec_id) AS least_id, max(vec_id) AS most_id, 0::BIGINT AS deleted, true AS has_bytes FROM embeddings")
def graph_inspect(spark, sf_dir):
    """Header and totals of the saved index: one row."""
    saved_index(spark, sf_dir)
    head = graph.inspect(spark, _saved[spark.sparkContext.applicationId, sf_dir])
    return head.select("format", "m", "rows", "dim", "least_id", "most_id", "deleted", (F.col("bytes") > 0).alias("has_bytes"))

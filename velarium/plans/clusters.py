"""Balanced clusters and graph partitions, from the embeddings alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, partition
from . import sqlnum as s
from .graphs import EDGES, knn_edges
from .vectors import rounded, vectors

QUERIES, ORACLES = {}, {}
CLUSTERS, ROUNDS, PARTS, STARTS = 8, 6, 6, 3


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _means_sql() -> str:
    """Centres c0 (the seeds) to c6, each from the nearest centres of the one before, in long form."""
    text = "c0 AS MATERIALIZED (SELECT t.step AS cluster, i, x FROM (SELECT DISTINCT step, seed FROM seeds) t JOIN e ON e.vec_id = t.seed)"
    for r in range(1, ROUNDS + 1):
        far = f"SELECT e.vec_id, c.cluster, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{r - 1} c USING (i) GROUP BY ALL"
        own = f"SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster FROM ({far}) GROUP BY vec_id"
        text += f", m{r} AS MATERIALIZED (SELECT cluster, i, avg(x) AS x FROM e JOIN ({own}) USING (vec_id) GROUP BY cluster, i)"
        text += f", c{r} AS MATERIALIZED (SELECT cluster, i, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN m{r} m USING (cluster, i))"
    return text


BALANCED = (
    "WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), "
    f"p AS MATERIALIZED ({s.all_pairs('fp32', where='true')}), "
    "seeds(step, seed, vec_id, d) AS (SELECT 0, qid, vec_id, d FROM p WHERE qid = (SELECT min(vec_id) FROM embeddings) UNION ALL "
    "SELECT q.step + 1, n.seed, q.vec_id, least(q.d, p.d) FROM seeds q, (SELECT arg_max(vec_id, (d, -vec_id)) AS seed FROM seeds) n JOIN p ON p.qid = n.seed WHERE p.vec_id = q.vec_id "
    f"AND q.step < {CLUSTERS - 1}), {_means_sql()}, "
    f"f AS MATERIALIZED (SELECT e.vec_id, c.cluster, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{ROUNDS} c USING (i) GROUP BY ALL), "
    f"cap AS (SELECT ceil(count(*) / {CLUSTERS})::BIGINT AS n FROM embeddings), "
    "a(step, vec_id, cluster, d, slot) AS (SELECT 0, *, row_number() OVER (PARTITION BY cluster ORDER BY d, vec_id) - 1 FROM (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM f GROUP BY vec_id) UNION ALL "
    "SELECT step + 1, vec_id, cluster, d, row_number() OVER (PARTITION BY cluster ORDER BY d, vec_id) - 1 FROM (SELECT step, vec_id, cluster, d FROM a, cap WHERE slot < n UNION ALL "
    "SELECT a.step, f.vec_id, arg_min(f.cluster, (f.d, f.cluster)), min(f.d) FROM a JOIN f USING (vec_id), cap WHERE a.slot >= cap.n AND (f.d > a.d OR f.d = a.d AND f.cluster > a.cluster) GROUP BY a.step, f.vec_id) "
    "WHERE (SELECT count(*) FROM a, cap WHERE slot >= n) > 0) "
    "SELECT vec_id, cluster::INTEGER AS cluster, round(d, 6) AS d, slot FROM a WHERE step = (SELECT max(step) FROM a)"
)


@query(BALANCED)
def balanced_kmeans(spark, sf_dir):
    """Eight clusters of at most an eighth of the vectors: farthest-first seeds, six rounds of means, proposals up to capacity."""
    found = clustering.balanced_kmeans(vectors(spark, sf_dir), CLUSTERS, ROUNDS)
    return rounded(found.select("vec_id", "cluster", (F.col("d") + 1e-12).alias("d"), "slot"), "d")


#: Nodes that each region takes in a hop of g.
TAKEN = (
    "SELECT r.start, r.node, r.part FROM (SELECT start, node, part, row_number() OVER (PARTITION BY start, part ORDER BY links DESC, node) AS k FROM ("
    "SELECT start, node, arg_max(part, (links, -part)) AS part, max(links) AS links FROM (SELECT g.start, u.b AS node, g.part, count(*) AS links FROM g JOIN u ON u.a = g.node GROUP BY ALL) q "
    "WHERE (start, node) NOT IN (SELECT (start, node) FROM g) GROUP BY start, node)) r JOIN (SELECT start, part, count(*) AS size FROM g GROUP BY ALL) z USING (start, part), cap WHERE z.size + r.k <= cap.n"
)
PARTITION = (
    f"WITH RECURSIVE e AS MATERIALIZED ({EDGES}), u AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), cap AS (SELECT ceil(count(*) / {PARTS})::BIGINT AS n FROM embeddings), "
    f"g(step, start, node, part) AS (SELECT 0, start, node, k - 1 FROM (SELECT t.start, vec_id AS node, row_number() OVER (PARTITION BY t.start ORDER BY md5(vec_id || ':' || t.start), vec_id) AS k FROM embeddings, range(0, {STARTS}) t(start)) WHERE k <= {PARTS} UNION ALL "
    f"SELECT m.step + 1, y.start, y.node, y.part FROM (SELECT start, node, part FROM g UNION ALL {TAKEN}) y, (SELECT max(step) AS step FROM g) m WHERE (SELECT count(*) FROM ({TAKEN})) > 0), "
    "last AS MATERIALIZED (SELECT start, node, part FROM g WHERE step = (SELECT max(step) FROM g)), "
    "free AS (SELECT start, part, row_number() OVER (PARTITION BY start ORDER BY part, n) AS k FROM (SELECT start, part, unnest(range(1, cap.n - size + 1)) AS n FROM (SELECT start, part, count(*) AS size FROM last GROUP BY ALL), cap)), "
    f"rest AS (SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY node) AS k FROM (SELECT t.start, vec_id AS node FROM embeddings, range(0, {STARTS}) t(start) EXCEPT SELECT start, node FROM last)), "
    "every AS MATERIALIZED (SELECT * FROM last UNION ALL SELECT start, rest.node, free.part FROM rest JOIN free USING (start, k)), "
    "cuts AS (SELECT p.start, count(*) FILTER (p.part <> q.part) AS cut FROM u JOIN every p ON p.node = u.a JOIN every q ON q.node = u.b AND q.start = p.start WHERE u.a < u.b GROUP BY p.start) "
    "SELECT node, part::INTEGER AS part, start::INTEGER AS start, cut FROM every JOIN (SELECT start, cut FROM cuts ORDER BY cut, start LIMIT 1) USING (start)"
)


@query(PARTITION)
def graph_partition(spark, sf_dir):
    """Six parts of the nearest-neighbour graph, of nearly equal size, with few edges between them: the best of three starts."""
    nodes = vectors(spark, sf_dir).select(F.col("vec_id").alias("node"))
    return partition.partition(nodes, knn_edges(spark, sf_dir), PARTS, STARTS)

"""Queries in Spark SQL alone, the schedule search, and thresholds as they are refreshed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import schedule, search, surface, thresholds
from ..sources.scratch import cut
from . import sqlnum as s
from .vectors import EXACT, EVERY, K, asked, vectors

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _view(spark, sf_dir) -> str:
    surface.register(spark)
    name = f"vectors_{uuid.uuid4().hex}"
    vectors(spark, sf_dir).createOrReplaceTempView(name)
    return name


KNN = """
WITH cells AS (SELECT greatest(8, ceil(count(*) / 65536)) AS n FROM {v}),
rows AS (
  SELECT false AS asked, vec_id AS id, embedding AS vec, pmod(xxhash64(vec_id), (SELECT n FROM cells)) AS cell FROM {v}
  UNION ALL
  SELECT true, vec_id, embedding, explode(sequence(0L, (SELECT n FROM cells) - 1)) FROM {v} WHERE vec_id % 25 = 0
)
SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(d + 1e-12, 6) + 0.0D AS d
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM nearest(TABLE(SELECT * FROM rows) PARTITION BY (cell), {k}, '{name}'))
WHERE rank <= {k}
"""


@query(EXACT)
def sql_knn(spark, sf_dir):
    """The exact search, in SQL: base rows dealt to cells, queries repeated, a table function for each cell, a ranked window."""
    return spark.sql(KNN.format(v=_view(spark, sf_dir), k=K, name="fp32"))


@query(s.topk(s.all_pairs("fp16_fpma"), K))
def sql_knn_half(spark, sf_dir):
    """The same by a distance of the registry."""
    return spark.sql(KNN.format(v=_view(spark, sf_dir), k=K, name="fp16_fpma"))


@query(f"SELECT qid, vec_id, round(f.d, 6) AS exact, round(h.d, 6) AS short FROM ({s.all_pairs('fp32', where='v.vec_id = q.vec_id + 1')}) f JOIN ({s.all_pairs('int8', where='v.vec_id = q.vec_id + 1')}) h USING (qid, vec_id)")
def sql_distances(spark, sf_dir):
    """Two distances of each vector to the next one, as SQL functions."""
    text = "SELECT a.vec_id AS qid, b.vec_id, round(vector_distance('fp32', a.embedding, b.embedding) + 1e-12, 6) AS exact, round(vector_distance('int8', a.embedding, b.embedding) + 1e-12, 6) AS short FROM {v} a JOIN {v} b ON b.vec_id = a.vec_id + 1"
    return spark.sql(text.format(v=_view(spark, sf_dir)))


def _depths_sql() -> str:
    """Pairs by the least number of leading bits whose bound exceeds the query's threshold."""
    part = "SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings"
    steps = [*s.fp16("h", "x"), ("g", "CASE WHEN h = 0 THEN pow(2.0, -24) ELSE abs(h) END"), *s.exponent("k0", "g"), ("k", "greatest(k0, -14)"), ("step", f"pow(2.0, k - (bits - {schedule.HEAD}))"), ("near", "floor(abs(h) / step) * step"), ("far", "near + step - pow(2.0, k - 10)")]
    exact = s.all_pairs("fp32", where=f"q.vec_id % {EVERY} = 0")
    return (
        f"p AS MATERIALIZED ({exact}), t AS (SELECT qid, d AS reach FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS k FROM p) WHERE k = {K}), "
        f"b AS MATERIALIZED (SELECT vec_id, i, bits, CASE WHEN h < 0 THEN -far ELSE near END AS lo, CASE WHEN h < 0 THEN -near ELSE far END AS hi FROM (SELECT *{''.join(f', {e} AS {n}' for n, e in steps)} FROM ({part}), (SELECT range AS bits FROM range({schedule.HEAD}, {schedule.BITS})))), "
        f"q AS MATERIALIZED (SELECT vec_id AS qid, i, h FROM (SELECT *{''.join(f', {e} AS {n}' for n, e in s.fp16('h', 'x'))} FROM ({part})) WHERE qid % {EVERY} = 0), "
        "g AS (SELECT bits, qid, vec_id, sum(pow(greatest(lo - h, h - hi, 0), 2)) AS lb FROM q JOIN b USING (i) GROUP BY ALL), "
        "l AS (SELECT qid, vec_id, min(bits) AS depth FROM g JOIN t USING (qid) WHERE lb > reach GROUP BY qid, vec_id), "
        f"c AS MATERIALIZED (SELECT depth, count(*) AS n FROM (SELECT CASE WHEN p.d > t.reach THEN coalesce(l.depth, {schedule.BITS}) ELSE {schedule.BITS} END AS depth FROM p JOIN t USING (qid) LEFT JOIN l USING (qid, vec_id)) GROUP BY depth)"
    )


@query(f"WITH {_depths_sql()} SELECT depth, n FROM c")
def bit_depths(spark, sf_dir):
    """Pairs by the leading bits after which their bound exceeds the query's tenth-nearest distance."""
    return _depths(spark, sf_dir).groupBy("depth").agg(F.sum("n").alias("n"))


def _depths(spark, sf_dir):
    base = vectors(spark, sf_dir)
    queries = asked(base, EVERY)
    reach = search.knn(base, queries, K).where(F.col("rank") == K).select("qid", F.col("d").alias("reach"))
    return schedule.depths(base, queries.join(cut(reach), "qid"), "reach")  # cells count their queries first: searched once


@query(
    f"WITH RECURSIVE {_depths_sql()}, w(steps, total) AS (SELECT [range], range FROM range(1, {schedule.BITS + 1}) UNION ALL SELECT list_append(steps, n.range), total + n.range FROM w, range(1, {schedule.BITS + 1}) n WHERE n.range <= steps[-1] AND total + n.range <= {schedule.BITS}), "
    f"e(steps, ends, pos) AS (SELECT steps, []::BIGINT[], 0::BIGINT FROM w UNION ALL SELECT steps, list_append(ends, least({schedule.BITS}, pos + steps[least(len(ends) + 1, len(steps))])), pos + steps[least(len(ends) + 1, len(steps))] FROM e WHERE pos < {schedule.BITS}), "
    f"f AS (SELECT ends, min(struct_pack(n := len(steps), steps := steps)).steps AS steps FROM e WHERE pos >= {schedule.BITS} GROUP BY ends), "
    "dim AS (SELECT max(len(embedding)) AS d FROM embeddings), "
    f"u AS (SELECT steps, unnest(range(1, len(ends) + 1)) AS i, ends, d FROM f, dim), "
    f"x AS (SELECT steps, d, CASE WHEN i > 1 THEN ends[i - 1] ELSE 0 END AS low, ends[i] AS high, list_sum(list_transform(range(1, i + 1), lambda j: ceil(d / floor({schedule.FETCH} / steps[least(j, len(steps))]))))::BIGINT AS paid FROM u), "
    "y AS (SELECT steps, d, sum(paid * n)::BIGINT AS fetches FROM x JOIN c ON depth > low AND depth <= high GROUP BY steps, d), "
    f"z AS (SELECT steps, fetches, list_sum(list_transform(steps, lambda w: ceil(d / floor({schedule.FETCH} / w)) * floor({schedule.FETCH} / w) / d * w)) / list_sum(steps) AS padding FROM y) "
    "SELECT array_to_string(steps, ',') AS steps, fetches, round(padding, 6) AS padding, round(fetches * padding, 3) AS score FROM z ORDER BY fetches * padding, len(steps), steps LIMIT 1"
)
def step_schedule(spark, sf_dir):
    """The widths in which components of the embeddings are best fetched, of all 914 lists that fit."""
    base = vectors(spark, sf_dir)
    dims = base.agg(F.max(F.size("embedding"))).first()[0]
    b = schedule.best(schedule.costs(_depths(spark, sf_dir), dims))
    return b.select(F.array_join("steps", ",").alias("steps"), "fetches", F.round("padding", 6).alias("padding"), F.round("score", 3).alias("score"))


@query(
    f"WITH p AS MATERIALIZED (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY vec_id) AS n, d FROM ({s.all_pairs('fp32')})), r AS (SELECT range AS seen FROM range({K}, (SELECT count(*) + 1 FROM embeddings), 5)), "
    f"t AS (SELECT qid, seen, list_sort(list(d))[{K}] AS threshold FROM p JOIN r ON n <= seen GROUP BY qid, seen) "
    "SELECT qid, seen, round(threshold, 6) AS threshold FROM (SELECT *, lag(threshold) OVER (PARTITION BY qid ORDER BY seen) AS before FROM t) WHERE before IS NULL OR threshold < before"
)
def threshold_refresh(spark, sf_dir):
    """Every change of each query's tenth-nearest distance, at the refreshes after 10, 15, 20, ... rows."""
    base = vectors(spark, sf_dir)
    return thresholds.running(base, asked(base), K).select("qid", "seen", (F.round(F.col("threshold") + 1e-12, 6) + 0.0).alias("threshold"))

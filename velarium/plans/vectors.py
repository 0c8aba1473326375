"""Vector queries: search, distances, bounds and their evaluation."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, numeric
from ..functions.distance import DISTANCES, norm2, normalized_clamped
from ..operators import sampling, search
from ..operators.analytics import percentile_of
from ..sources.scratch import cut
from . import sqlnum as s

K = 10
QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def asked(base: DataFrame, every: int = 25) -> DataFrame:
    return search.as_queries(base.where(F.col("vec_id") % every == 0))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


def out(hits: DataFrame) -> DataFrame:
    """Hits with rounded distances; exact halves of the last digit, which engines round differently, are nudged up."""
    return rounded(hits.select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", (F.col("d") + 1e-12).alias("d")), "d")


def scaled(base: DataFrame, by: float) -> DataFrame:
    return base if by == 1.0 else base.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * by))


#: Whole-number distances are asked on vectors that have been scaled up.
SCALES = {"l2_int": 127.0, "int16_diff_fpma": 100.0}


def _distance_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scaled(vectors(spark, sf_dir), SCALES.get(name, 1.0))
    return out(search.knn(base, asked(base), K, name))


for _name in DISTANCES:
    QUERIES[f"dist_{_name}"] = partial(_distance_query, _name)
    ORACLES[f"dist_{_name}"] = s.topk(s.all_pairs(_name, SCALES.get(_name, 1.0)), K)

EXACT = s.topk(s.all_pairs("fp32"), K)


@query(EXACT)
def knn_exact(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return out(search.knn(base, asked(base), K))


@query(EXACT)
def knn_blocked(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return out(search.knn_blocked(base, asked(base), K))


@query(EXACT)
def knn_filter_refine(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return out(search.filter_and_refine(base, asked(base), K))


@query(s.topk(f"SELECT p.* FROM ({s.all_pairs('fp32')}) p JOIN embeddings e USING (vec_id) WHERE e.label = 3 AND vec_id % 2 = 0", K))
def knn_filtered(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return out(search.knn(base, asked(base), K, where=(F.col("label") == 3) & (F.col("vec_id") % 2 == 0)))


@query(f"SELECT qid, rank::INTEGER AS rank, vec_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM ({s.all_pairs('fp32')})) WHERE rank <= 20 AND (d <= 1.2 OR rank <= 3)")
def range_search(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return out(search.range_search(base, asked(base), 1.2, least=3, most=20))


@query(
    f"SELECT qid, rank::INTEGER AS rank, doc_id, vec_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM "
    f"(SELECT qid, vec_id % 50 AS doc_id, min(d) AS d, arg_min(vec_id, (d, vec_id)) AS vec_id FROM ({s.all_pairs('fp32')}) GROUP BY qid, vec_id % 50)) WHERE rank <= 5"
)
def knn_multivector(spark, sf_dir):
    base = vectors(spark, sf_dir).withColumn("doc", F.col("vec_id") % 50)
    hits = search.knn_multivector(base, asked(base), 5, "doc")
    return rounded(hits.withColumn("rank", F.col("rank").cast("int")), "d")


@query(f"SELECT qid, round(d, 6) AS bound FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM ({s.all_pairs('fp32')})) WHERE rank = 10")
def kth_bound(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return search.knn(base, asked(base), K).where(F.col("rank") == K).select("qid", F.round("d", 6).alias("bound"))


@query(f"SELECT qid, count(*) AS hits FROM ({EXACT}) a JOIN (SELECT qid, vec_id FROM ({s.topk(s.all_pairs('fp32'), 100)}) WHERE rank <= 10) b USING (qid, vec_id) WHERE rank <= 5 GROUP BY qid")
def gt_prefix(spark, sf_dir):
    """Hits of the widest truth's prefix in a shallower search: always the shallower k."""
    base = vectors(spark, sf_dir)
    wide = search.knn(base, asked(base), 100)
    return search.hits_at(search.knn(base, asked(base), 5).where("rank <= 5"), wide, K)


def _recall_sql(name: str, k: int = K) -> str:
    return f"SELECT qid, count(f.vec_id) AS hits FROM (SELECT qid, vec_id FROM ({s.topk(s.all_pairs('fp32'), k)})) t LEFT JOIN (SELECT qid, vec_id FROM ({s.topk(s.all_pairs(name), k)})) f USING (qid, vec_id) GROUP BY qid"


@query(f"SELECT round(sum(hits) / (count(*) * 10), 6) AS recall FROM ({_recall_sql('fp16_fpma')})")
def recall_at_k(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return rounded(search.recall(search.knn(base, asked(base), K, "fp16_fpma"), search.knn(base, asked(base), K), K), "recall")


@query(f"SELECT qid, round(hits / 10, 6) AS recall FROM ({_recall_sql('int8')})")
def recall_per_query(spark, sf_dir):
    base = vectors(spark, sf_dir)
    hits = search.hits_at(search.knn(base, asked(base), K, "int8"), search.knn(base, asked(base), K), K)
    return hits.select("qid", F.round(F.col("hits") / K, 6).alias("recall"))


EVALUATED = ["fp32", "fp16_true", "fp16_fpma", "fp8_e4m3", "fp8_fpma", "int8"]


def precision_results(spark, sf_dir) -> DataFrame:
    """precision, qid, hits against the exact search, for all precisions in one job."""
    base = vectors(spark, sf_dir)
    truth = search.knn(base, asked(base), K).select("qid", "vec_id")
    found = None
    for name in EVALUATED:
        f = search.knn(base, asked(base), K, name).select(F.lit(name).alias("precision"), "qid", "vec_id")
        found = f if found is None else found.unionByName(f)
    return found.join(truth.withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left").groupBy("precision", "qid").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))


PRECISION_SQL = " UNION ALL ".join(f"SELECT '{n}' AS precision, * FROM ({_recall_sql(n)})" for n in EVALUATED)


@query(f"SELECT precision, round(sum(hits) / (count(*) * 10), 6) AS recall, round(1 - sum(hits) / (count(*) * 10), 6) AS recall_loss FROM ({PRECISION_SQL}) GROUP BY precision")
def precision_eval(spark, sf_dir):
    r = precision_results(spark, sf_dir).groupBy("precision").agg((F.sum("hits") / (F.count("*") * K)).alias("recall"))
    return rounded(r.withColumn("recall_loss", 1 - F.col("recall")), "recall", "recall_loss")


@query("SELECT metric, fp32, fp16_fpma, int8 FROM (SELECT 'recall' AS metric, " + ", ".join(f"printf('%.2f%%', 100 * sum(hits) FILTER (precision = '{n}') / (count(*) FILTER (precision = '{n}') * 10)) AS {n}" for n in ("fp32", "fp16_fpma", "int8")) + f" FROM ({PRECISION_SQL}))")
def table5_pivot(spark, sf_dir):
    r = precision_results(spark, sf_dir).where(F.col("precision").isin("fp32", "fp16_fpma", "int8"))
    p = r.groupBy(F.lit("recall").alias("metric")).pivot("precision", ["fp32", "fp16_fpma", "int8"]).agg(100 * F.sum("hits") / (F.count(F.lit(1)) * K))
    return p.select("metric", *[F.format_string("%.2f%%", F.col(c)).alias(c) for c in ("fp32", "fp16_fpma", "int8")])


# Vectors themselves


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2 FROM embeddings")
def vector_norms(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(norm2(F.col("embedding")), 6).alias("norm2"))


@query("SELECT vec_id, i::INTEGER AS i, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS x FROM embeddings)")
def l2_normalize(spark, sf_dir):
    n = sampling.normalized(vectors(spark, sf_dir)).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rounded(n, "x")


@query("SELECT min(vec_id) FILTER (vec_id % 7 = 5 OR vec_id % 50 = 31) AS lowest, count(*) FILTER (vec_id % 7 = 5 OR vec_id % 50 = 31) AS bad FROM embeddings")
def l2_normalize_refused(spark, sf_dir):
    """What strict normalisation says of a table with zero vectors and with infinities: its lowest bad row, and how many."""
    by = F.when(F.col("vec_id") % 7 == 5, 0.0).when(F.col("vec_id") % 50 == 31, float("inf")).otherwise(1.0)
    v = vectors(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: F.when(by == 1.0, x.cast("double")).otherwise(by)))
    try:
        sampling.normalized(v)
    except sampling.BadVectors as e:
        return spark.createDataFrame([(e.lowest, e.bad)], "lowest long, bad long")
    raise AssertionError("planted rows were accepted")


@query("SELECT vec_id, i::INTEGER AS i, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE * 3 / greatest(3 * sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12) AS x FROM embeddings)")
def l2_normalize_clamped(spark, sf_dir):
    v = scaled(vectors(spark, sf_dir), 3.0)
    return rounded(v.select("vec_id", F.posexplode(normalized_clamped(F.col("embedding"))).alias("i", "x")), "x")


@query("SELECT vec_id, round(n, 6) AS norm FROM (SELECT vec_id, (1 + CASE WHEN vec_id % 50 = 0 THEN 0.01 ELSE 0 END) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) WHERE abs(n - 1) > 2e-5")
def unit_norm_violations(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("f", F.when(F.col("vec_id") % 50 == 0, 1.01).otherwise(1.0))
    return v.select("vec_id", (F.col("f") * F.sqrt(norm2(F.col("embedding")))).alias("norm")).where(F.abs(F.col("norm") - 1) > 2e-5).select("vec_id", F.round("norm", 6).alias("norm"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding)::INTEGER AS dim FROM embeddings WHERE vec_id = 42")
def get_by_label(spark, sf_dir):
    return vectors(spark, sf_dir).where(F.col("vec_id") == 42).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").alias("dim"))


FP16_SWEEP = "SELECT bits, CASE WHEN bits // 1024 % 32 = 0 THEN 0 ELSE pow(2.0, bits // 1024 % 32 - 15) * (1 + (bits % 1024) / 1024.0) END AS x FROM (SELECT range AS bits FROM range(1024, 31744))"


@query(
    "SELECT count(*) AS n, round(avg(abs(t - x * x) / (x * x)), 6) AS mean_error, round(max(abs(t - x * x) / (x * x)), 6) AS max_error, arg_max(bits, (abs(t - x * x) / (x * x), -bits)) AS worst FROM (SELECT *"
    + "".join(f", {e} AS {n}" for n, e in s.square("t", "x", 10, s.T8, 8, -14, 16))
    + f" FROM ({FP16_SWEEP})) WHERE t > 0 AND t < 'inf'::DOUBLE"
)
def fpma_error_stats(spark, sf_dir):
    """Relative error of the approximate square over all positive normal half-precision numbers."""
    bits = spark.range(1024, 31744).withColumn("x", F.pow(F.lit(2.0), F.shiftright("id", 10) - 15) * (1 + F.col("id").bitwiseAND(1023) / 1024))
    e = bits.withColumn("t", numeric.square_fp16(F.col("x"))).where((F.col("t") > 0) & (F.col("t") < float("inf")))
    err = F.abs(F.col("t") - F.col("x") * F.col("x")) / (F.col("x") * F.col("x"))
    worst = F.max(F.struct(err.alias("e"), (-F.col("id")).alias("i")))["i"]
    return e.agg(F.count("*").alias("n"), F.round(F.avg(err), 6).alias("mean_error"), F.round(F.max(err), 6).alias("max_error"), (-worst).alias("worst"))


@query(f"SELECT bits, ((((bits & 32767) << 1) & 32767) + (17408 | {s.T16}[((bits & 32767) >> 6) % 16 + 1])) & 32767 AS square_bits FROM (SELECT range AS bits FROM range(0, 65536)) WHERE (bits >> 10) & 31 BETWEEN 1 AND 30")
def rtl_square_sweep(spark, sf_dir):
    """The circuit's square of all 61,440 normal encodings."""
    bits = spark.range(65536).withColumnRenamed("id", "bits").where(F.shiftright("bits", 10).bitwiseAND(31).between(1, 30))
    return bits.select("bits", numeric.rtl_square(F.col("bits")).cast("long").alias("square_bits"))


def _codec_sql(kind: str) -> str:
    wide, bits, bias = numeric.FP8_FIELDS[kind]
    one = float(1 << bits)
    steps = [("a", "abs(x)"), *s.exponent("e", "a"), ("m", f"round_even((a / pow(2.0, e) - 1) * {one}, 0)"), ("f", f"e + {bias} + (m >= {one})::INT")]
    columns = "".join(f", {x} AS {n}" for n, x in steps)
    code = f"CASE WHEN a < pow(2.0, {1 - bias}) THEN 0 WHEN f >= {(1 << wide) - 1} THEN 127 ELSE f * {one} + CASE WHEN m >= {one} THEN 0 ELSE m END END + CASE WHEN x < 0 THEN 128 ELSE 0 END"
    return f"SELECT '{kind}' AS kind, vec_id, i, ({code})::INTEGER AS code FROM (SELECT *{columns} FROM (SELECT vec_id, i, x * 20 AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INTEGER AS i FROM embeddings)))"


@query(" UNION ALL ".join(_codec_sql(k) for k in numeric.FP8_FIELDS))
def fp8_codes(spark, sf_dir):
    """8-bit encodings of scaled components, in the three formats."""
    v = vectors(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double") * 20)
    kinds = [v.select(F.lit(k).alias("kind"), "vec_id", "i", numeric.fp8_encode(F.col("x"), k).alias("code")) for k in numeric.FP8_FIELDS]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


# The compensation in SQL, from its definition: the mean error of each cell of leading bits, over all pairs of significands.
CELLS = (
    "SELECT i * 16 + j AS cell, CASE WHEN i = 15 AND j = 15 THEN 0 ELSE floor(total / 8388608.0 + 0.5) END::BIGINT AS comp FROM (SELECT x // 64 AS i, y // 64 AS j, "
    "sum(CASE WHEN (1024 + x) * (1024 + y) < 2097152 THEN 2 * x * y ELSE (1024 - x) * (1024 - y) END) AS total FROM (SELECT range AS x FROM range(1024)), (SELECT range AS y FROM range(1024)) GROUP BY i, j)"
)


@query(
    "SELECT a, b, ((xor(a, b) >> 15) & 1) << 15 | (((((a & 32767) + (b & 32767)) & 65535) + (50176 | comp)) & 32767) AS product_bits "
    f"FROM (SELECT range AS a, (range * 31337 + 4099) % 65536 AS b FROM range(0, 65536)) JOIN ({CELLS}) ON cell = ((a >> 6) & 15) * 16 + ((b >> 6) & 15)"
)
def rtl_product_sweep(spark, sf_dir):
    """The circuit's product of every encoding with another one."""
    p = spark.range(65536).select(F.col("id").alias("a"), F.pmod(F.col("id") * 31337 + 4099, F.lit(65536)).alias("b"))
    return p.select("a", "b", numeric.rtl_product(F.col("a"), F.col("b")).cast("long").alias("product_bits"))


# Samples


@query("SELECT vec_id FROM embeddings ORDER BY md5(vec_id || ':7'), vec_id LIMIT 20")
def query_sample(spark, sf_dir):
    return sampling.seeded_sample(vectors(spark, sf_dir), "vec_id", 20, 7).select("vec_id")


@query("WITH q AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings WHERE vec_id % 25 = 0), t AS (SELECT count(*) AS c FROM q) SELECT r.range AS position, vec_id FROM range(0, 50) r, t JOIN q ON q.n = r.range % t.c")
def query_repeat(spark, sf_dir):
    return sampling.cyclic(vectors(spark, sf_dir).where(F.col("vec_id") % 25 == 0), "vec_id", 50).select("position", "vec_id")


@query("SELECT vec_id, CASE WHEN vec_id % 10 <> 0 THEN row_number() OVER (PARTITION BY vec_id % 10 <> 0 ORDER BY vec_id) - 1 END AS new_id FROM embeddings")
def holdout_split(spark, sf_dir):
    held, kept = sampling.holdout_split(vectors(spark, sf_dir), "vec_id", F.col("vec_id") % 10 == 0)
    return kept.select("vec_id", "new_id").unionByName(held.select("vec_id", F.lit(None).cast("long").alias("new_id")))


@query("SELECT vec_id, vec_id % 32 AS modulo, vec_id // 16 AS chunk, vec_id // 16 % 32 AS stripe FROM embeddings")
def partition_modulo(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id")
    p = sampling.place(v, "vec_id", 32, "modulo").withColumnRenamed("part", "modulo")
    p = sampling.place(p, "vec_id", 32, "chunk").withColumnRenamed("part", "chunk")
    return sampling.place(p, "vec_id", 32, "stripe").withColumnRenamed("part", "stripe")


ASSIGNED = s.all_pairs("fp32", where="q.vec_id < 8")


NEAREST = f"SELECT vec_id, arg_min(qid, (d, qid))::INTEGER AS cluster, min(d) AS d FROM ({ASSIGNED}) GROUP BY vec_id"


def assigned(spark, sf_dir) -> DataFrame:
    """The nearest of 8 given centres."""
    v = vectors(spark, sf_dir)
    given = [r["embedding"] for r in v.where("vec_id < 8").orderBy("vec_id").collect()]
    return sampling.assign(v, given)


@query(f"SELECT vec_id, cluster, round(d, 6) AS d FROM ({NEAREST})")
def kmeans_assign(spark, sf_dir):
    return rounded(assigned(spark, sf_dir), "d")


@query(f"SELECT vec_id, cluster, (row_number() OVER (PARTITION BY cluster ORDER BY vec_id) - 1) % 4 AS part FROM ({NEAREST})")
def cluster_round_robin(spark, sf_dir):
    a = assigned(spark, sf_dir)
    return sampling.positions(a, ["vec_id"], ["cluster"], "n").select("vec_id", "cluster", (F.col("n") % 4).cast("long").alias("part"))


@query(f"SELECT vec_id, cluster, k - 1 AS slot, k > 50 AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, vec_id) AS k FROM ({NEAREST}))")
def cluster_capacity(spark, sf_dir):
    """At most 50 vectors a cluster keep their place."""
    return sampling.balanced(assigned(spark, sf_dir), 50).select("vec_id", "cluster", F.col("slot").cast("long").alias("slot"), "overflow")


@query(f"SELECT vec_id, cluster, (k - 1) // 16 AS pack, (k - 1) % 16 AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, vec_id) AS k FROM ({NEAREST}))")
def packing_groups(spark, sf_dir):
    """Groups of 16 near vectors, for storage side by side."""
    return sampling.packed_groups(assigned(spark, sf_dir), 16)


KMEANS_STEP = "SELECT cluster, i, avg(x) AS x FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) JOIN ({n}) USING (vec_id) GROUP BY cluster, i"


@query(f"SELECT cluster, i::INTEGER AS i, round(x, 6) AS x FROM ({KMEANS_STEP.format(n=NEAREST)})")
def kmeans_step(spark, sf_dir):
    """The centres after one round from the given ones."""
    spread = vectors(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    means = assigned(spark, sf_dir).join(spread, "vec_id").groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return rounded(means, "x")


# Bounds and pruning


#: Queries of the bounds and of the boundary log: the stated set.
EVERY = 50


def pairs_of(spark, sf_dir, every: int = EVERY) -> DataFrame:
    base = vectors(spark, sf_dir)
    return search.pairs(base, asked(base, every))


def bounded(spark, sf_dir, *names: str) -> DataFrame:
    """qid, vec_id and d0, d1, ... of every base row with the stated queries, worked out in cells."""
    base = vectors(spark, sf_dir)
    return search.pair_distances(base, asked(base, EVERY), list(names))


LONG = "SELECT q.vec_id AS qid, v.vec_id, q.i, q.x AS q, v.x AS v FROM ({e}) q JOIN ({e}) v USING (i) WHERE q.vec_id % 50 = 0".format(e="SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings")
COARSE = "SELECT *, CASE WHEN abs(h) < pow(2.0, -14) THEN 0 WHEN (q < 0) <> (h < 0) THEN abs(q) * pow(2.0, k) ELSE -2 * abs(q) * pow(2.0, k) END AS t FROM (SELECT *" + "".join(f", {e} AS {n}" for n, e in [*s.fp16("h", "v"), ("g", "abs(h)"), *s.exponent("k", "g")]) + f" FROM ({LONG}))"


@query(f"SELECT qid, vec_id, round(2 + 2 * sum(trunc(t * 16384) / 16384), 6) AS lb FROM ({COARSE}) GROUP BY qid, vec_id")
def lower_bound_unit(spark, sf_dir):
    return rounded(bounded(spark, sf_dir, "unit").withColumnRenamed("d0", "lb"), "lb")


@query(f"SELECT qid, vec_id, round(greatest(0, sum(q * q) + sum(v * v) + 2 * sum(t)), 6) AS lb FROM ({COARSE}) GROUP BY qid, vec_id")
def lower_bound_l2(spark, sf_dir):
    return rounded(bounded(spark, sf_dir, "l2").withColumnRenamed("d0", "lb"), "lb")


def _bits_sql(bits: int) -> str:
    keep = bits - 6
    return (
        "SELECT qid, vec_id, sum(gap * gap) AS lb FROM (SELECT *, CASE WHEN p < lo THEN lo - p WHEN p > hi THEN p - hi ELSE 0 END AS gap FROM "
        "(SELECT *, CASE WHEN h < 0 THEN -far ELSE near END AS lo, CASE WHEN h < 0 THEN -near ELSE far END AS hi FROM (SELECT *"
        + "".join(f", {e} AS {n}" for n, e in [*s.fp16("p", "q"), *s.fp16("h", "v"), ("g", "CASE WHEN h = 0 THEN pow(2.0, -24) ELSE abs(h) END"), *s.exponent("k0", "g"), ("k", "greatest(k0, -14)"), ("step", f"pow(2.0, k - {keep})"), ("near", "floor(abs(h) / step) * step"), ("far", "near + step - pow(2.0, k - 10)")])
        + f" FROM ({LONG})))) GROUP BY qid, vec_id"
    )


@query(f"SELECT qid, vec_id, round(lb, 6) AS lb FROM ({_bits_sql(8)})")
def lower_bound_bits(spark, sf_dir):
    return rounded(bounded(spark, sf_dir, "bits8").withColumnRenamed("d0", "lb"), "lb")


@query(f"SELECT qid, vec_id, round(CASE WHEN lb > 1.2 + 1e-6 THEN lb ELSE d END, 6) AS d, lb > 1.2 + 1e-6 AS pruned FROM ({_bits_sql(8)}) JOIN ({s.all_pairs('fp16_fpma', where='q.vec_id % 50 = 0')}) USING (qid, vec_id)")
def bit_level_prune(spark, sf_dir):
    """The bound itself where it exceeds the threshold, else the distance."""
    p = bounded(spark, sf_dir, "bits8", "fp16_fpma").withColumn("pruned", F.col("d0") > 1.2 + 1e-6)
    return rounded(p.select("qid", "vec_id", F.when(F.col("pruned"), F.col("d0")).otherwise(F.col("d1")).alias("d"), "pruned"), "d")


@query(
    "SELECT qid, vec_id, round(sum((q - c) * (q - c)), 6) AS partial, sum((q - c) * (q - c)) >= 0.8 AS rejected FROM (SELECT *, CASE WHEN v = 0 THEN 0 ELSE sign(v) * floor(abs(v) / pow(2.0, k - 7)) * pow(2.0, k - 7) END AS c FROM (SELECT *"
    + "".join(f", {e} AS {n}" for n, e in [("g", "abs(v)"), *s.exponent("k", "g")])
    + f" FROM ({LONG} AND i < 32))) GROUP BY qid, vec_id"
)
def partial_distance_prune(spark, sf_dir):
    """Half the dimensions at 16 bits; rejected from the bound on."""
    p = bounded(spark, sf_dir, "first32").withColumnRenamed("d0", "partial")
    return p.select("qid", "vec_id", F.round("partial", 6).alias("partial"), (F.col("partial") >= 0.8).alias("rejected"))


@query(f"SELECT qid, count(*) AS calls, sum((lb > 1.2)::INT)::BIGINT AS pruned, round(100.0 * sum((lb > 1.2)::INT) / count(*), 6) AS et_pct FROM ({_bits_sql(8)}) GROUP BY qid")
def et_ratio(spark, sf_dir):
    base = vectors(spark, sf_dir)
    p = search.counted(base, asked(base, EVERY), ["bits8"], lambda lb: [np.full(len(lb), lb.shape[1]), (lb > 1.2).sum(axis=1)], "calls long, pruned long").groupBy("qid")
    return p.agg(F.sum("calls").alias("calls"), F.sum("pruned").alias("pruned"), F.round(100.0 * F.sum("pruned") / F.sum("calls"), 6).alias("et_pct"))


# The boundary log, emulated on the exact scan in id order: each row meets the nearest one so far.


def boundary_log(spark, sf_dir, tally, schema: str, each=None) -> DataFrame:
    base = vectors(spark, sf_dir)
    return search.boundaries(base, asked(base, EVERY), "fp16_true", "fp16_fpma", tally, schema, each)


BOUNDARY = (
    "SELECT *, c_exact < b_exact AS exact_accept, c_fpma < b_fpma AS fpma_accept FROM (SELECT qid, vec_id AS candidate_id, b.vec_id AS boundary_id, b.c_exact AS b_exact, c_exact, b.c_fpma AS b_fpma, c_fpma FROM ("
    "SELECT e.qid, e.vec_id, e.d AS c_exact, f.d AS c_fpma, min({'c_exact': e.d, 'vec_id': e.vec_id, 'c_fpma': f.d}) OVER (PARTITION BY e.qid ORDER BY e.vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b "
    f"FROM ({s.all_pairs('fp16_true', where='q.vec_id % 50 = 0')}) e JOIN ({s.all_pairs('fp16_fpma', where='q.vec_id % 50 = 0')}) f USING (qid, vec_id)) WHERE b IS NOT NULL)"
)


@query(f"SELECT qid, count(*) AS comparisons, round(100.0 * count(*) FILTER (b_exact > 0 AND c_exact > 0 AND b_exact > c_exact AND b_exact / c_exact < 1.0073) / count(*), 6) AS risk_pct, round(100.0 * count(*) FILTER (exact_accept <> fpma_accept) / count(*), 6) AS flip_pct FROM ({BOUNDARY}) GROUP BY qid")
def boundary_risk_flip(spark, sf_dir):
    def tally(n, candidate, boundary, b, c, b_fpma, c_fpma):
        with np.errstate(divide="ignore", invalid="ignore"):
            risk = (b > 0) & (c > 0) & (b > c) & (b / c < 1.0073)
        return [np.array([m]) for m in (n, risk.sum(), ((c < b) != (c_fpma < b_fpma)).sum())]

    log = boundary_log(spark, sf_dir, tally, "qid long, n long, risk long, flip long")
    share = lambda x: F.round(100.0 * F.sum(x) / F.sum("n"), 6)
    return log.groupBy("qid").agg(F.sum("n").alias("comparisons"), share("risk").alias("risk_pct"), share("flip").alias("flip_pct"))


@query(
    "SELECT qid, candidate_id, boundary_id, "
    "round(CASE WHEN least(b_exact, c_exact) > 0 THEN (greatest(b_exact, c_exact) - least(b_exact, c_exact)) / least(b_exact, c_exact) ELSE 0 END, 6) AS rel_gap, "
    "round(CASE WHEN b_exact + c_exact > 0 THEN abs(b_exact - c_exact) / (b_exact + c_exact) ELSE 0 END, 6) AS normalized_margin, "
    "round(CASE WHEN b_exact > 0 THEN (b_fpma - b_exact) / b_exact ELSE 0 END, 6) AS signed_err_b, round(CASE WHEN c_exact > 0 THEN (c_fpma - c_exact) / c_exact ELSE 0 END, 6) AS signed_err_c "
    f"FROM ({BOUNDARY})"
)
def boundary_errors(spark, sf_dir):
    def ratio(up, down):
        return kernels.rounded(np.divide(up, down, out=np.zeros(len(up)), where=~(down <= 0)))  # NaN is greater than any number

    def errors(b, c, b_fpma, c_fpma):
        with np.errstate(over="ignore", invalid="ignore"):
            lo = np.fmin(b, c)
            return [ratio(np.maximum(b, c) - lo, lo), ratio(np.abs(b - c), b + c), ratio(b_fpma - b, b), ratio(c_fpma - c, c)]

    # A row a pair: what is done to it is done on arrays.
    return boundary_log(spark, sf_dir, None, "qid long, candidate_id long, boundary_id long, rel_gap double, normalized_margin double, signed_err_b double, signed_err_c double", errors)


@query(
    "WITH e AS (SELECT i, k FROM (SELECT *" + "".join(f", {e} AS {n}" for n, e in [("g", "abs(x)"), *s.exponent("k", "g")]) + " FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)) WHERE g > 0), "
    "p AS (SELECT i, quantile_disc(k, 0.05) AS low, quantile_disc(k, 0.95) AS high FROM e GROUP BY i) "
    "SELECT e.i::INTEGER AS i, low::INTEGER AS low, high::INTEGER AS high, count(*) FILTER (k < low OR k > high) AS outliers FROM e JOIN p USING (i) GROUP BY e.i, low, high"
)
def exponent_outliers(spark, sf_dir):
    """Components whose exponent lies outside its dimension's trimmed range."""
    e = vectors(spark, sf_dir).select(F.posexplode("embedding").alias("i", "x")).where("x <> 0").select("i", numeric.exponent(F.abs(F.col("x").cast("double"))).alias("k"))
    e = cut(e)
    p = percentile_of(e, ["i"], "k", {"low": 0.05, "high": 0.95})
    return e.join(p, "i").groupBy("i", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")).agg(F.count_if((F.col("k") < F.col("low")) | (F.col("k") > F.col("high"))).alias("outliers"))


@query("SELECT vec_id, vec_id % 4 AS channel, vec_id // 4 % 2 AS rank, vec_id // 8 % 4 AS bankgroup, vec_id // 32 % 4 AS bank, vec_id // 128 % 64 AS col, vec_id // 8192 AS row_, xor(vec_id // 32 % 4, (vec_id // 8192) % 4) AS bank_xor FROM (SELECT vec_id * 977 AS vec_id FROM embeddings)")
def addr_map(spark, sf_dir):
    """Bit slices of an address, low to high: channel, rank, bank group, bank, column, row; and the bank mixed with the row."""
    a = vectors(spark, sf_dir).select((F.col("vec_id") * 977).alias("vec_id"))
    part = lambda at, bits: F.shiftright("vec_id", at).bitwiseAND((1 << bits) - 1)
    return a.select(
        "vec_id", part(0, 2).alias("channel"), part(2, 1).alias("rank"), part(3, 2).alias("bankgroup"), part(5, 2).alias("bank"), part(7, 6).alias("col"),
        F.shiftright("vec_id", 13).alias("row_"), part(5, 2).bitwiseXOR(F.shiftright("vec_id", 13).bitwiseAND(3)).alias("bank_xor"),
    )

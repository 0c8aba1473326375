"""The pipeline against brute force, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from velarium.llm import mixing
from velarium.llm.common import cut

from .test_operators import check_places, plain_components


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = labels.join(stages[0].select("doc_id"), "doc_id", "left_semi")
    assert kept.where("toxic = 0").count() >= 0.97 * labels.where("toxic = 0").count()
    assert kept.where("toxic = 1").count() <= 0.35 * labels.where("toxic = 1").count()


def test_one_of_each_group_stays(stages):
    want = plain_components([(r["doc_id"], r["text"]) for r in stages[0].collect()])
    assert sorted(r["doc_id"] for r in stages[1].collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_copies_follow_the_mix(stages):
    mixed = mixing.mix(stages[1]).where("copies > 0").groupBy("doc_id").agg(F.sum("copies").alias("n"))
    assert {(r["doc_id"], r["n"]) for r in mixed.collect()} == {(r["doc_id"], r["count"]) for r in stages[2].groupBy("doc_id").count().collect()}


def test_every_piece_has_a_place(stages):
    rows = stages[3].collect()
    check_places(rows)
    assert sum(r["piece"] == 0 for r in rows) == stages[2].count()


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[3].count()


def odd_tables(spark, at, documents, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars int, size long, score string, key long, text_2 string"
    spark.createDataFrame(documents, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_odd_rows(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    row = lambda i, text, source="s": (i, text, "en", source, 0, 1, "clash", 2, None)
    text = lambda n: " ".join(words[(n * k + k * k) % 10] + str(n * k % 7) for k in range(30 + n % 9))
    documents = [row(i, text(i) + (" vile" * (i % 5 == 0)), ("a", "b", None)[i % 3]) for i in range(200)]
    documents += [row(1, documents[1][1], "b"), row(None, "a null id"), row(None, "a null id"), row(None, None, None), row(300, None), row(301, ""), row(302, " \t\n"), row(303, "x" * 40_000), row(303, "another text of that id")]
    documents += [(None,) * 9, row(304, documents[7][1]), row(305, documents[7][1].upper())]
    labels = [(i, int(i % 5 == 0), 1) for i in range(200)] + [(None, 1, 1), (3, None, 1), (300, 0, None), (1, 0, 0)]
    at = odd_tables(spark, tmp_path, documents, labels)
    docs, stages = spark.read.parquet(f"{at}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, at))
        stages.append(docs)
    kept = [r["doc_id"] for r in stages[0].collect()]
    assert not any(i is not None and i < 200 and i % 5 == 0 for i in kept) and {1, 303, 304, 305} <= set(kept) and kept.count(None) == 4
    single = [r["doc_id"] for r in stages[1].collect()]
    assert single.count(None) == 4 and 7 in single and not {304, 305} & set(single) and single.count(1) <= 2 and single.count(303) == 2
    rows = stages[3].collect()
    check_places(rows)
    assert sum(r["piece"] == 0 for r in rows) == stages[2].count() > 0


def test_empty_tables(spark, tmp_path):
    at = odd_tables(spark, tmp_path, [], [])
    out = corpus_pipeline.run(spark, at)
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

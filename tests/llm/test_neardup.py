"""Near duplicates against all pairs in Python, with groups that are cut into many parts."""

import random

import pytest
from pyspark.sql import functions as F

from velarium.llm import neardup

from .test_operators import plain_components

SCHEMA = "doc_id long, text string, n_shingles string, kept int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(parts)


def words(draw, n, vocabulary=4000):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def changed(draw, base, edits):
    out = list(base)
    for at in draw.sample(range(len(out)), edits):
        out[at] = f"x{draw.randrange(10**6)}"
    return out


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("group", [4, 12])
def test_groups_in_many_parts_equal_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    monkeypatch.setattr(neardup, "REPS", 2)
    monkeypatch.setattr(neardup, "MANY", 1)
    draw, rows = random.Random(group), []
    for n in (90, 40, 25):
        base = words(draw, 120)
        rows += [" ".join(changed(draw, base, draw.randint(0, 5))) for _ in range(n)]
    # Chains: each text is like its neighbours only, so most members are apart from any representative.
    base = words(draw, 120)
    for _ in range(60):
        base = changed(draw, base, 2)
        rows.append(" ".join(base))
    rows += [" ".join(words(draw, 60)) for _ in range(40)]
    rows += rows[:30]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    assert result(neardup.near_duplicates(frame(spark, rows))) == plain_components(rows)


def test_near_copies_move_their_texts_once(spark):
    draw = random.Random(3)
    base = words(draw, 200)
    rows = [(i, " ".join(changed(draw, base, draw.randint(0, 5)))) for i in range(6000)]
    docs = frame(spark, rows)
    met = spark.sparkContext.accumulator(0)

    def counted(payloads):
        met.add(len(payloads))
        return neardup._exact(payloads)

    members = docs.select(F.lit(0).cast("long").alias("key"), "doc_id", "text")
    sizes = spark.createDataFrame([(0, 13)], "key long, parts int")
    edges = neardup.meetings(members, sizes, "text", counted)
    assert neardup.components(edges).where("root = 0").count() == 6000
    assert met.value <= 2 * 6000
    got = neardup.near_duplicates(docs)
    assert got.where("component_id = 0").count() == 6000 and got.where("kept").count() == 1


def test_recall_just_above_the_threshold(spark):
    """Pairs with a similarity from 0.75 to 0.80, no third text near them: all are found."""
    draw, rows, want = random.Random(8), [], 0
    while want < 1500:
        base = words(draw, draw.randint(60, 220), 10**6)
        other = changed(draw, base, 1 + len(base) // 48)
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, other))
        similar = len(a & b) / len(a | b)
        if 0.75 <= similar < 0.80:
            rows += [(2 * want, " ".join(base)), (2 * want + 1, " ".join(other))]
            want += 1
    got = result(neardup.near_duplicates(frame(spark, rows)))
    assert sum(got[2 * n + 1][1] == 2 * n for n in range(want)) == want


def test_ids_that_repeat_with_other_texts(spark):
    draw = random.Random(1)
    a, b, c = (" ".join(words(draw, 40)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c), (None, a), (5, None), (6, ""), (7, " \t")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (None, None, True)]
    left = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(frame(spark, rows)).collect()]
    assert sorted(left, key=repr) == sorted([(1, a), (1, b), (4, c), (None, a), (5, None), (6, ""), (7, " \t")], key=repr)

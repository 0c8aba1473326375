"""Sharding against a plain version: keys sorted, cut at equal bytes."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from velarium.llm import sharding

SCHEMA = "doc_id long, text string, slot string, _row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(4)


def loads(rows, shards=16):
    out = [0] * shards
    for r in rows:
        out[r["shard"]] += r["size"]
    return out


def check(rows, want, largest):
    """All rows are there, slots are gapless, and no shard is further from its share than one row and the tolerance."""
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(want)
    for n in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == n)
        assert slots == list(range(len(slots)))
    load = loads(rows)
    share = sum(load) / 16
    assert all(abs(x - share) <= 2 * largest + 0.002 * share + 1 for x in load), load


def plain_shards(spark, rows, shards=16):
    """Each row's shard by sorting all keys and cutting at the bytes nearest to a share."""
    keys = sharding.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id").collect()
    order = sorted(keys, key=lambda r: (r["_hi"], r["_lo"]))
    total = sum(r["size"] for r in order)
    out, below = {}, 0
    for r in order:
        out[r["doc_id"]] = (below * shards / total, (below + r["size"]) * shards / total)
        below += r["size"]
    return out


def test_shards_follow_the_sorted_keys(spark):
    draw = random.Random(2)
    rows = [(i, "x" * draw.randint(0, 90) + str(i)) for i in range(4000)]
    got = sharding.shard(frame(spark, rows)).collect()
    spans, share = plain_shards(spark, rows), 0.002
    for r in got:
        low, high = spans[r["doc_id"]]
        assert low - share <= r["shard"] + 1 and high + share >= r["shard"]
    check(got, rows, 95)


def test_equal_rows_and_rows_without_an_id_are_split(spark):
    rows = [(None, None)] * 4000 + [(5, "equal rows")] * 4000 + [(i, f"row {i:05d} x") for i in range(4000)]
    check(sharding.shard(frame(spark, rows)).collect(), rows, 13)


def test_a_hot_text_is_split_by_id_and_ranges_are_numbered_through(spark, monkeypatch):
    rows = [(i, "a hot text " * 3 if i % 3 else f"text {i} " * (i % 50)) for i in range(6000)]
    for size in (1 << 30, 1000):
        monkeypatch.setattr(sharding, "RANGE", size)
        check(sharding.shard(frame(spark, rows)).collect(), rows, 500)


def test_one_long_text(spark):
    rows = [(0, "y" * 200_000)] + [(i, "short") for i in range(1, 2000)]
    got = sharding.shard(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)


def test_empty_tables_and_texts(spark):
    assert sharding.shard(frame(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, "x")]
    got = sharding.shard(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"], r["size"]) for r in got) == Counter([(1, None, 1), (2, "", 1), (3, "x", 2)])


@pytest.mark.parametrize("seed", range(4))
def test_places_equal_tuple_order(seed):
    rng = np.random.default_rng(seed)
    edges = sorted(tuple(int(x) for x in r) for r in rng.integers(0, 4, (60, 3)))
    keys = rng.integers(0, 4, (500, 3))
    got = sharding.places([keys[:, n] for n in range(3)], [np.array([e[n] for e in edges]) for n in range(3)])
    assert got.tolist() == [sum(e <= tuple(int(x) for x in k) for e in edges) for k in keys]


def test_query_columns(spark, sf_dir):
    from velarium.llm.queries import QUERIES

    out = QUERIES["op6_sharding"](spark, sf_dir)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = out.collect()
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes"
    assert out.select(F.max("shard")).first()[0] == 15


def test_columns_with_the_names_used_inside(spark):
    names = ["_hi", "_lo", "_at", "_row", "_to", "own", "row_id"]
    rows = spark.createDataFrame([(i % 3, "t") for i in range(50)], "doc_id long, text string").selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    out = sharding.shard(rows)  # equal rows: they are numbered
    assert out.columns == ["doc_id", "text", *names, "size", "shard", "slot"]
    assert all([r[n] for n in names] == names for r in out.collect()) and out.count() == 50


def test_groups_stay_whole_where_half_a_percent_allows(spark):
    # 3,000 texts of 4 copies: a group is 0.5 % of a shard.
    rows = [(i, f"text {i % 3000:04d}") for i in range(12_000)]
    got = sharding.shard(frame(spark, rows)).collect()
    check(got, rows, 40)
    where = {}
    for r in got:
        where.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    load = loads(got)
    assert max(load) - min(load) <= 0.02 * sum(load) / 16


def test_ranges_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE", 10)
    monkeypatch.setattr(sharding, "RANGES", 64)
    rows = [(i, f"row {i}") for i in range(3000)]
    narrow = sharding.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    edges, per_shard, _ = sharding.splitters(narrow, 16)
    assert len(edges) == 63 and per_shard == 4
    got = sharding.shard(frame(spark, rows))
    assert got.rdd.getNumPartitions() == 64
    check(got.collect(), rows, 13)

"""Mixing against a plain version in Python and its SQL, on sources with repeated, hot and null ids."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import duckdb
import pytest

from velarium.llm import mixing
from velarium.llm.oracles import OP4

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, copies string"


def plain_targets(words):
    """Targets by filling one source after another, in fractions."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(order)}
    target, open_, total = {}, set(order), Fraction(3, 2) * sum(words.values())
    while True:
        share = total - sum(target.values())
        level = share / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] >= 2 * words[s]}
        if not over:
            return {s: float(target.get(s, level * weight[s])) for s in order}
        for s in over:
            target[s] = Fraction(2 * words[s])
        open_ -= over


def plain_taken(rows):
    """Counter of (id, size, words of the source, words taken) by the rule, row by row."""
    sized = [(i, t or "", s, len(mixing_words(t))) for i, t, s in rows]
    words = Counter()
    for _, _, s, n in sized:
        words[s] += n
    target, out = plain_targets(words), Counter()
    for s in words:
        own = [(i, t, n) for i, t, source, n in sized if source == s]
        copies = int(target[s] // words[s]) if words[s] else 0
        need = target[s] - copies * words[s]
        sizes = sorted({n for _, _, n in own if n}, reverse=True)
        rate = 0.0
        for size in sizes:
            above = sum(n for _, _, n in own if n > size)
            rate = (need - above) / sum(n * n for _, _, n in own if n <= size)
            if rate * size <= 1:
                break
        order = []
        for at, (i, t, n) in enumerate(own):
            name = hashlib.md5(f"{'null' if i is None else i}:11:{t}".encode()).hexdigest()
            u, pi = (int(name[:13], 16) + 0.5) / 2**52, rate * n
            if pi > 0:
                order.append((0.0 if pi >= 1 else u / (1 - u) * ((1 - pi) / pi), name, at, n))
        order.sort()
        got, taken = 0, set()
        for _, _, at, n in order:
            if got + n > need:
                break
            got += n
            taken.add(at)
        spare = min(((abs(need - got - n), key, name, at) for key, name, at, n in order if at not in taken and n < 2 * (need - got)), default=None)
        if spare:
            taken.add(spare[3])
        for at, (i, _, n) in enumerate(own):
            out[i, n, words[s], (copies + (at in taken and copies < 2)) * n] += 1
    return out


def mixing_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def prose(n, draw):
    return " ".join(draw.choice("ab cd efg".split()) for _ in range(n))


def sources(seed):
    draw = random.Random(seed)
    rows = [(i, prose(min(int(draw.lognormvariate(2.5, 1.2)), 400), draw), draw.choice(["web", "web", "web", "books", "Web", None])) for i in range(900)]
    rows += [(None, "the same text again", "nulls")] * 500 + [(7, f"one id {i}", "hot") for i in range(300)] + [(8, "one row", "hot")] * 300
    rows += [(2000 + i, None, "empty") for i in range(5)] + [(2100, " \t\n", "empty"), (2101, "alone", "one"), (2102, prose(9000, draw), "long"), (2103, "x", "long")]
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "en", s, 0, -1, "clash") for i, t, s in rows], SCHEMA).repartition(parts)


def result(out):
    return Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_version_and_reruns_agree(spark, seed):
    rows = sources(seed)
    want = plain_taken(rows)
    assert result(mixing.mix(frame(spark, rows))) == want
    assert result(mixing.mix(frame(spark, rows[::-1], 7))) == want


def test_equals_its_sql(spark, tmp_path):
    rows = sources(3)
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = mixing.mix(spark.read.parquet(str(tmp_path / "d")), columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
    assert Counter(tuple(r) for r in got.collect()) == Counter(c.execute(OP4).fetchall())


def test_each_source_comes_near_its_target(spark):
    out = mixing.mix(frame(spark, sources(4))).groupBy("source").agg({"target": "max", "taken": "sum", "size": "max"}).collect()
    for r in out:
        assert abs(r["max(target)"] - r["sum(taken)"]) <= max(1, 0.5 * r["max(size)"])
    equal = [(None, "five words in this text", "a")] * 5000 + [(i, "b " * 5, "b") for i in range(5000)]
    for r in mixing.mix(frame(spark, equal)).groupBy("source").agg({"target": "max", "taken": "sum"}).collect():
        assert abs(r["max(target)"] - r["sum(taken)"]) <= 2.5


def test_the_pareto_sample_is_not_that_of_u_alone(spark):
    draw = random.Random(9)
    rows = [(i, prose(draw.choice([1, 2, 4, 8, 16]), draw), "ab"[i % 2] + "x" * (i % 2)) for i in range(3000)]
    share = {}
    for r in mixing.mix(frame(spark, rows)).collect():
        if r["target"] < 2 * r["source_size"]:
            certain = int(r["target"] // r["source_size"])
            share.setdefault(r["size"], []).append(r["copies"] - certain)
    means = [sum(v) / len(v) for _, v in sorted(share.items())]
    assert all(a < b or b == 1 for a, b in zip(means, means[1:], strict=False))


def test_empty_and_extra_columns(spark):
    out = mixing.mix(frame(spark, []))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "copies", "taken"]


def test_running_sums_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 50)
    totals = spark.createDataFrame([(f"s{i:04d}" if i else None, (i * 37) % 101) for i in range(400)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(totals).collect()}
    want = plain_targets({(f"s{i:04d}" if i else None): (i * 37) % 101 for i in range(400)})
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def test_columns_with_the_names_used_inside(spark):
    names = ["key", "rate", "low", "edge", "_s", "_chosen", "_row", "_name", "_u", "_source", "own", "_copy", "need", "before"]
    docs = frame(spark, [(i, "a b c", "s") for i in range(20)]).selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    out = mixing.mix(docs)
    assert out.columns == [*[c for c in docs.columns if c not in mixing.RESULTS], *mixing.RESULTS]
    assert all([r[n] for n in names] == names for r in out.collect()) and out.count() == 20
    assert mixing.expanded(out, ["_copy", "doc_id"]).where("_copy = '_copy'").count() == 30

"""Boundaries, lists and cuts against regular expressions and slices; odd cases."""

import hashlib
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velarium.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@given(st.text(" \n\tabé\U0001f600 \x0e", max_size=60), st.integers(1, 9))
def test_boundaries_are_those_of_the_pattern(text, run):
    before, fim.RUN = fim.RUN, run
    try:
        found = fim.boundaries(text)
    finally:
        fim.RUN = before
    assert found.tolist() == [m.end() for m in TOKEN.finditer(text)]


@given(st.sets(st.integers(1, 100_000), min_size=1, max_size=300), st.integers(0, 10**9))
def test_lists_select(values, beyond):
    v = sorted(values)
    data = fim.elias_fano(np.array(v), v[-1] + beyond)
    assert [fim.select(data, k) for k in range(len(v))] == v


def test_lists_are_small():
    v = np.arange(1, 100_001) * 6
    assert len(fim.elias_fano(v, 600_000)) < 100_000 * 4.5 / 8 + 20


def plain(doc_id, text):
    t = text or ""
    k = TOKEN.findall(t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(k)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(k[:a]), "".join(k[a:b]), "".join(k[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, rows):
    out = fim.transformed(df)
    out = out.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    found = sorted(((r["doc_id"], *(r[c] for c in fim.RESULTS), r["back"]) for r in out.collect()), key=str)
    assert found == sorted(((i, *plain(i, t), t or "") for i, t in rows), key=str)
    return out


def test_documents(spark):
    texts = ["", None, " ", "a", " a", "a ", "one two  three\n\n", "é ü 😀 x", "with <P> marker", "ends <", "<S", "P> odd", "word " * 60_000, "same text here"]
    rows = [(i, texts[i % len(texts)]) for i in range(300)] + [(None, "no id at all"), (None, None), (5, "x y"), (5, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    odd = df.selectExpr("*", *[f"'u' AS `{c}`" for c in ("n", "own", "key", "salt", "h", "_key", "at", "ends", "id", "form", "_")])
    out = check(odd, rows)
    assert out.columns == ["doc_id", "own", "key", "salt", "h", "_key", "at", "ends", "id", "_", *fim.RESULTS, "back"]
    assert out.where("own <> 'u' OR key <> 'u' OR salt <> 'u' OR _ <> 'u' OR id <> 'u'").count() == 0
    assert check(df.limit(0), []).count() == 0


def test_hot_texts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fim, "COPIES", 50)
    rows = [(i, "a text that everyone copies" if i % 3 else f"text {i} of its own") for i in range(1500)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)

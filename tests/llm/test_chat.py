"""Reply trees against plain recursion, the template's round trip, and odd cases."""

import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velarium.llm import chat

SCHEMA = "tree long, id long, parent long, role string, text string, score double"


def plain_paths(rows):
    """Of each tree its paths, best first: by score, leaf id, content."""
    said = [dict(zip(chat.MESSAGE, r, strict=True), n=n) for n, r in enumerate(rows)]
    content = lambda m: (m["role"] or "", hashlib.sha256((m["text"] or "").encode()).hexdigest(), m["n"])
    first = {}
    for m in said:
        if m["id"] is not None:
            k = m["tree"], m["id"]
            first[k] = min(first.get(k, m), m, key=content)
    up = {m["n"]: first.get((m["tree"], m["parent"])) if m["parent"] is not None and m["parent"] != m["id"] else None for m in said}
    answered = {u["n"] for u in up.values() if u}
    out = {}
    for m in said:
        if m["n"] in answered:
            continue
        path, seen = [m], {m["n"]}
        while path is not None and (u := up[path[-1]["n"]]):
            if u["n"] in seen:
                path = None
            else:
                seen.add(u["n"])
                path.append(u)
        if path:
            score = sum(x["score"] or 0 for x in path)
            out.setdefault(m["tree"], []).append((-score, m["id"] is not None, m["id"] or 0, content(m), path[::-1]))
    return {t: [x[-1] for x in sorted(v, key=lambda x: x[:-1])] for t, v in out.items()}


def whole(stored):
    out = {}
    for r in sorted(stored.collect(), key=lambda r: r["segment"]):
        out[r["tree"], r["path"]] = out.get((r["tree"], r["path"]), "") + r["formatted"]
    return out


def check(spark, rows, top):
    found = whole(chat.formatted(spark.createDataFrame(rows, SCHEMA), top))
    want = {(t, k): [(m["role"] or "", m["text"] or "") for m in p] for t, paths in plain_paths(rows).items() for k, p in enumerate(paths) if top is None or k < top}
    assert {k: chat.parsed(v) for k, v in found.items()} == want


def test_trees(spark):
    rng = random.Random(3)
    rows = []
    for tree in (1, 2, 3, None):
        for i in range(40):
            parent = rng.choice([None, *range(i)]) if i else None
            rows.append((tree, i, parent, rng.choice(["user", "assistant", None, "a:b\\"]), rng.choice(["#", "</turn>", "x", None, "\\", "### user: y</turn>\n"]), rng.choice([0.0, 1.0, -2.0, None])))
    for top in (1, 3, None):
        check(spark, rows, top)


def test_odd_messages(spark):
    rows = [
        (1, 0, None, "user", "a", 1.0),
        (1, 0, None, "user", "a", 1.0),  # the same once more: a branch of its own
        (1, 1, 0, "assistant", "b", None),
        (1, 5, 99, "user", "parent missing", 0.5),
        (1, 6, 6, "user", "its own parent", 0.5),
        (1, 7, 8, "user", "circle", 9.0),
        (1, 8, 7, "user", "circle", 9.0),
        (1, 9, 8, "user", "below a circle", 9.0),
        (1, None, 1, "user", "no id", 0.0),
        (2, 1, 0, None, None, None),
    ]
    check(spark, rows, None)
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
    more = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("n")).withColumn("_row", F.lit(0)).withColumn("path", F.lit(7))
    assert whole(chat.formatted(more, None)) == whole(chat.formatted(spark.createDataFrame(rows, SCHEMA), None))


def test_deep_and_wide_trees(spark):
    deep = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"{i}#", 0.1) for i in range(300)]
    wide = [(2, i, 0 if i else None, "assistant", str(i), float(i % 7)) for i in range(200)]
    stored = chat.formatted(spark.createDataFrame(deep + wide, SCHEMA))
    assert stored.where("tree = 1").count() == -(-300 // chat.TURNS)
    check(spark, deep + wide, 2)
    r = {x["tree"]: x for x in chat.read_back(stored).collect()}
    assert r[1]["n_turns"] == 300 and r[1]["loss_sha256"] == hashlib.sha256("".join(f"{i}#" for i in range(1, 300, 2)).encode()).hexdigest()
    assert r[1]["turns_sha256"] == hashlib.sha256("".join(f"{m[3]}\n{m[4]}\n" for m in deep).encode()).hexdigest()


def test_levels_halve_the_joins(spark):
    links = spark.createDataFrame([(i, i - 1, 1.0) for i in range(1, 101)], "node long, up long, gain double")
    steps, circles = chat.levels(links)
    assert not circles and len(steps) == 7  # 1, 2, 4, ... 64 of 100


def test_conversations_with_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (None, None, None, None), (3, 2, "assistant", "z" * 200_000), (3, 2, "assistant", "z" * 200_000), (3, 1, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = {x["tree"]: x for x in chat.read_back(chat.formatted(chat.chained(turns, "conv_id", "turn"))).collect()}
    assert r[None]["n_turns"] == 2 and r[None]["turns_sha256"] == hashlib.sha256(b"\n\nuser\nx\n").hexdigest()
    assert r[3]["n_turns"] == 3 and r[3]["loss_chars"] == 400_000
    assert chat.read_back(chat.formatted(chat.chained(turns.limit(0), "conv_id", "turn"))).count() == 0


@given(st.lists(st.tuples(st.text("#:/<\\> turn\n", max_size=12), st.text("#:/<\\> turn\n", max_size=30)), max_size=4))
def test_template_round_trip(turns):
    esc = lambda s, more="": "".join("\\" + c if c in "\\#" + more or c == "/" and s[i - 1 : i] == "<" else c for i, c in enumerate(s))
    text = "".join(f"### {esc(r, ':')}: {esc(t)}</turn>\n" for r, t in turns)
    assert chat.parsed(text) == turns

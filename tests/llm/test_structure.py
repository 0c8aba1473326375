"""The repair against plain dynamic programming over audits, and odd cases."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from velarium.llm import structure
from velarium.llm.structure import Automaton

SCHEMA = "conv_id long, turn long, role string, text string"
SYMBOL = st.tuples(st.sampled_from("sua."), st.sampled_from("-tx")).map("".join)


def plain(symbols):
    """Least (cost, audit) by growing every grammar prefix; the grammar is checked by the regular expression itself."""
    best = {"": (0, "")}  # what is written so far, cut to what matters -> cost, audit

    def key(out):
        return out if out in ("", "s") else out[-1]

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for out, (c, a) in list(states.items()):
                for i in "ua":
                    new = out + i
                    if re.fullmatch(r"s?(ua)*u?", new if out in ("", "s") else {"u": "u", "a": "ua"}[out] + i):
                        k = key(new)
                        states[k] = min(states.get(k, (10**9, "")), (c + 2, a + "I"))
        return states

    best = inserted(best)
    for initial, fault in symbols:
        new = {}
        for out, (c, a) in best.items():
            options = [(3, "D", "")]
            if fault != "x":
                extra = fault == "t"
                options += [(extra, "K", initial), (2 + extra, "R", "u"), (2 + extra, "R", "a")]
            for w, letter, i in options:
                full = out + i if out in ("", "s") else {"u": "u", "a": "ua"}[out] + i
                if i and not re.fullmatch(r"s?(ua)*u?", full):
                    continue
                k = key(out + i) if i else out
                new[k] = min(new.get(k, (10**9, "")), (c + w, a + letter))
        best = inserted(new)
    return min(best[k] for k in ("", "a") if k in best)


@settings(max_examples=400)
@given(st.lists(SYMBOL, max_size=14))
def test_audit_is_the_least(symbols):
    cost, edits, tail = Automaton().repair(symbols)
    audit = "".join("I" * len(i) + e for i, e, _ in edits) + "I" * len(tail)
    assert (cost, audit) == plain(symbols)


def test_few_states():
    rng = random.Random(1)
    a = Automaton()
    for _ in range(300):
        a.repair(["".join((rng.choice("sua."), rng.choice("--tx"))) for _ in range(200)])
    assert len(a.vectors) < 100 and len(a.table) < 1000


def of(rows):
    """The contract's columns of one conversation's rows after damage, plainly."""
    content = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, content(r)))
    seen, faults, symbols = set(), [], []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        symbols.append((role[:1] if role[:1] in ("s", "u", "a") else ".") + {"blank": "x", "duplicate": "x", "truncated": "t", "": "-"}[fault])
    cost, audit = plain(symbols)
    out, at, lines = "", 0, []
    for letter in audit:
        role, text = (rows[at][1], rows[at][2]) if letter != "I" else ("", "")
        if letter in "IR":
            role = "assistant" if out[-1:] == "u" else "user"
        if letter != "D":
            out += role[:1]
            lines.append(f"{role}:{text}")
        at += letter != "I"
    assert re.fullmatch(r"(s?(ua)+)?", out)
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = zip(rows, rows[1:], strict=False)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(conv, turn, "user" if h == 4 else role, text)] * (1 + (h == 3))
    return out


def test_conversations(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(12)):
            turn = None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]) if rng.random() < 0.9 else 3
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "no", None, "", "a b! \n", "Why? ", "x" * 50_000 + "."])))
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({}).selectExpr("*", "1 AS place", "2 AS symbol", "'c' AS conv", "3 AS h")
    found = {r["conv"]: r.asDict() for r in structure.repair_report(structure.damaged(df), df.selectExpr("conv_id AS conv")).collect()}
    left = harm(rows)
    assert set(found) == {r[0] for r in rows}
    for conv, r in found.items():
        r.pop("conv")
        assert r == of([x[1:] for x in left if x[0] == conv]), conv


def test_empty_tables_and_long_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert structure.repair_report(structure.damaged(empty), empty.selectExpr("conv_id AS conv")).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    r = structure.repair_report(structure.damaged(one), one.selectExpr("conv_id AS conv")).collect()
    assert [x.asDict() for x in r] == [{"conv": gone, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}]
    long = [(7, i, "assistant" if i % 2 else "user", f"{i}.") for i in range(structure.BATCH + 5)]
    rows = spark.createDataFrame(long, SCHEMA).selectExpr("conv_id AS conv", "turn", "role", "text")
    r = structure.repaired(rows).first()
    assert r["audit"] == "K" * len(long) + "I" and r["cost"] == 2
    assert r["repaired_sha256"] == hashlib.sha256("\n".join([*(f"{x[2]}:{x[3]}" for x in long), "assistant:"]).encode()).hexdigest()

"""Conversation structure repair by lazy weighted determinisation.

A conversation is a sequence of rows; a repair keeps a row, gives it another
role, deletes it, or inserts an empty turn, each at a cost, so that the roles'
initials read ``(s?(ua)+)?``.  What a prefix of rows allows is a vector with
the least cost of each of the four grammar states.  Normalised to a least
entry of 0 and freed of entries that cannot be on a cheapest repair, such
vectors become the states of a deterministic automaton: they are few, since
entries differ by a few edits at most.  Its transitions (state, kind of row)
are worked out when first met and cached in a table with what they cost, so
the scan of a conversation is one table lookup a row.

The audit comes from a trace back over tight arcs, those on which the two
vectors differ by exactly the edit's cost: it marks the grammar states that lie on some cheapest repair,
again by a cached table, and the walk forward over marked states takes the
edit with the least letter each time (D, I, K, R).  Every letter leads to one
state, so this is the ASCII-least audit.

Rows are put in order over the whole table; symbols, not texts, are grouped by
conversation, and repaired texts are digested as a stream.  One task scans a
conversation and holds three bytes a row of it besides its audit, which is one
value by its definition.

Defined cases: null roles and texts are one space; rows with equal turns are
ordered by role and text together (their digest); a role that begins with none
of s, u, a cannot be kept; a null conversation is one of its own; a
conversation without rows has zeros, an empty audit and the digest of nothing;
other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut
from .ordering import joined_digests, placed

SPACES = " \t\n\v\f\r"
#: Costs of the edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after s, after u, after a.  Where an initial leads, and what must come next.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
ACCEPT = (0, 3)
NEVER = 1 << 40


def _closed(costs: list[int]) -> list[int]:
    """With insertions, which lead from any state to the next."""
    for _ in range(2):
        for q, to in NEXT.items():
            costs[to] = min(costs[to], costs[q] + INSERT)
    return costs


def _useful(costs: list[int]) -> list[int]:
    """Without entries that state 3 beats for every future: it can do what 1 can, and what 0 can for one deletion more."""
    if costs[1] > costs[3]:
        costs[1] = NEVER
    if costs[0] > costs[3] + DELETE:
        costs[0] = NEVER
    return costs


class Automaton:
    """Vectors are numbered as they are met; symbols are an initial (s, u, a or .) and a fault (``-``, t for truncated, x for must go)."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.marks: dict[tuple, int] = {}
        self.walks: dict[tuple, tuple[str, str, int]] = {}
        self.start = self._state([0, NEVER, NEVER, NEVER])[0]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        costs = _useful(_closed(costs))
        least = min(costs)
        vector = tuple(c - least if c < NEVER else NEVER for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    @staticmethod
    def arcs(q: int, symbol: str) -> list[tuple[str, int, int]]:
        """Edits of a row from a grammar state: letter, cost, state."""
        initial, fault = symbol
        out = [("D", DELETE, q)]
        if fault != "x":
            more = TRUNCATED if fault == "t" else 0
            if (q, initial) in KEEP:
                out.append(("K", more, KEEP[q, initial]))
            out.append(("R", REROLE + more, NEXT[q]))
        return out

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """The next state and what is taken off its vector."""
        if (state, symbol) not in self.table:
            costs = [NEVER] * 4
            for q, c in enumerate(self.vectors[state]):
                if c < NEVER:
                    for _, w, to in self.arcs(q, symbol):
                        costs[to] = min(costs[to], c + w)
            self.table[state, symbol] = self._state(costs)
        return self.table[state, symbol]

    def _with_inserts(self, state: int, marked: int) -> int:
        v = self.vectors[state]
        for _ in range(2):
            for q, to in NEXT.items():
                if marked >> to & 1 and v[q] < NEVER and v[q] + INSERT == v[to]:
                    marked |= 1 << q
        return marked

    def marked(self, state: int, symbol: str, after: int) -> int:
        """Grammar states before a row from which tight arcs lead to those marked ``after`` it."""
        key = state, symbol, after
        if key not in self.marks:
            to_state, off = self.step(state, symbol)
            v, w = self.vectors[state], self.vectors[to_state]
            tight = [q for q in range(4) if v[q] < NEVER and any(after >> to & 1 and v[q] + c == w[to] + off for _, c, to in self.arcs(q, symbol))]
            self.marks[key] = self._with_inserts(state, sum(1 << q for q in tight))
        return self.marks[key]

    def end(self, state: int) -> tuple[int, int]:
        """The cost of ending here and the marked states."""
        v = self.vectors[state]
        least = min(v[q] for q in ACCEPT)
        return least, self._with_inserts(state, sum(1 << q for q in ACCEPT if v[q] == least))

    def walk(self, state: int, q: int, symbol: str, here: int, after: int) -> tuple[str, str, int]:
        """From grammar state q: the states inserted before a row, its edit, and the state behind it."""
        key = state, q, symbol, here, after
        if key not in self.walks:
            to_state, off = self.step(state, symbol)
            v, w, inserted = self.vectors[state], self.vectors[to_state], ""
            while True:
                edits = {e: to for e, c, to in self.arcs(q, symbol) if after >> to & 1 and v[q] + c == w[to] + off}
                if here >> NEXT[q] & 1 and v[q] + INSERT == v[NEXT[q]]:
                    edits["I"] = NEXT[q]
                edit = min(edits)
                q = edits[edit]
                if edit != "I":
                    break
                inserted += str(q)
            self.walks[key] = inserted, edit, q
        return self.walks[key]

    def repair(self, symbols: list[str]) -> tuple[int, list[tuple[str, str, int]], str]:
        """Cost; for each row what is inserted before it, its edit and the state behind it; what is inserted at the end."""
        states, cost = array("H", [self.start]), 0
        for s in symbols:
            state, off = self.step(states[-1], s)
            states.append(state)
            cost += off
        least, marked = self.end(states[-1])
        marks = bytearray(len(states))
        marks[-1] = marked
        for i in range(len(symbols) - 1, -1, -1):
            marks[i] = self.marked(states[i], symbols[i], marks[i + 1])
        q, out = 0, []
        for i, s in enumerate(symbols):
            out.append(self.walk(states[i], q, s, marks[i], marks[i + 1]))
            q = out[-1][2]
        tail, v = "", self.vectors[states[-1]]
        while not (q in ACCEPT and v[q] == least):
            q = NEXT[q]
            tail += str(q)
        return cost + least, out, tail


EDITS = StructType([StructField("place", LongType()), StructField("inserted", StringType()), StructField("edit", StringType()), StructField("role", StringType()), StructField("cost", LongType()), StructField("audit", StringType()), StructField("illegal", LongType())])
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
#: A scan gives out its rows in batches of so many.
BATCH = 50_000


def _lines(states: str) -> str | None:
    return "\n".join(f"{ROLE[int(q)]}:" for q in states) or None


def _edited(symbols: DataFrame) -> DataFrame:
    """For each row (conv, place, symbol) its edit; a conversation's last row has no place and sums it up."""

    def repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, kind, key, places, seen, started = Automaton(), None, None, array("q"), [], False

        def done() -> Iterator[pa.RecordBatch]:
            cost, edits, tail = automaton.repair(seen)
            for k in range(0, len(seen), BATCH):
                rows = [(p, _lines(i), e, ROLE[q] if e == "R" else None, None, None, None) for p, (i, e, q) in zip(places[k : k + BATCH], edits[k : k + BATCH], strict=True)]
                yield made(rows)
            audit = "".join("I" * len(i) + e for i, e, _ in edits) + "I" * len(tail)
            illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(seen, seen[1:], strict=False))
            yield made([(None, _lines(tail), None, None, cost, audit, illegal)])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([key] * len(rows), kind), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)]]
            return pa.record_batch(columns, names=["conv", *EDITS.names])

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, place, symbol in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if started and conv != key:
                    yield from done()
                    places, seen = array("q"), []
                key, started = conv, True
                places.append(place)
                seen.append(symbol)
        if started:
            yield from done()

    # Symbols are few bytes for the work they make: by number, Spark does not put them into fewer partitions.
    parts = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = symbols.select("conv", "place", "symbol").repartition(parts, "conv").sortWithinPartitions("conv", "place")
    return rows.mapInArrow(repairs, StructType([symbols.schema["conv"], *EDITS.fields]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role and text after the contract's damage; nulls of role and text are one space."""
    space = F.lit(" ")
    c = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    c = c.withColumn("h", F.crc32(F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20)
    c = c.where("h <> 0").withColumn("text", F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    c = c.withColumn("role", F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")))
    return c.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1)))).select("conv", "turn", "role", "text")


def _last(text: Column) -> Column:
    """A text's last character that is no white space, or nothing."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def repaired(rows: DataFrame) -> DataFrame:
    """Of each conversation of ``rows`` (conv, turn, role, text): faults, cost, audit and the repaired text's digest."""
    space = F.lit(" ")
    rows = rows.select("conv", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = placed(rows.withColumn("content", content), [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("content")])
    last, initial = _last(F.col("text")), F.substring("role", 1, 1)
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("none")
    judged = rows.select("conv", "turn", "place", "content", fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise(".").alias("initial"))
    # The first of equal rows, found by partial sums of one place each; the others are told by not being it.
    first = judged.groupBy("conv", "content").agg(F.min("place").alias("_first")).select("_first")
    judged = judged.join(first, F.col("place") == F.col("_first"), "left")
    judged = judged.withColumn("fault", F.when((F.col("fault") != "blank") & F.col("_first").isNull(), "duplicate").otherwise(F.col("fault")))
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("-")
    judged = cut(judged.select("conv", "turn", "place", "fault", F.concat("initial", kind).alias("symbol")))
    edits = cut(_edited(judged))
    turn = F.col("turn").cast("decimal(38,0)")
    gaps = F.coalesce((F.max(turn) - F.min(turn) + 1 - F.count_distinct("turn")).cast("long"), F.lit(0).cast("long"))
    faults = judged.groupBy("conv").agg(gaps.alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    own = edits.where("place is not null").select(F.col("place").alias("_place"), "inserted", "edit", F.col("role").alias("_role"))
    line = F.when(F.col("edit") != "D", F.concat(F.coalesce("_role", "role"), F.lit(":"), "text"))
    pieces = rows.join(own, F.col("place") == F.col("_place")).select("conv", "place", F.concat_ws("\n", "inserted", line).alias("piece"))
    tails = edits.where("place is null").select("conv", F.lit((1 << 63) - 1).alias("place"), F.coalesce("inserted", F.lit("")).alias("piece"))
    digests = joined_digests(pieces.unionByName(tails).where("piece <> ''"), "conv", "place", "piece", "\n")
    sums = edits.where("place is null").select(F.col("conv").alias("_c"), "cost", "audit", "illegal")
    out = faults.join(sums, F.col("conv").eqNullSafe(F.col("_c"))).drop("_c")
    digests = digests.select(F.col("conv").alias("_c"), "sha256")
    nothing = hashlib.sha256().hexdigest()
    out = out.join(digests, F.col("conv").eqNullSafe(F.col("_c")), "left")
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``repaired`` for every conversation (conv) of ``conversations``, also those without rows."""
    zero, found = F.lit(0).cast("long"), repaired(rows)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = conversations.select(F.col("conv").alias("_all")).distinct().join(found, F.col("_all").eqNullSafe(F.col("conv")), "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("_all").alias("conv"), *[F.coalesce(c, zero).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))

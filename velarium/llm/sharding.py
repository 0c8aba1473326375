"""Sharding by histogram sort: equal bytes in each shard, one exchange.

Rows are ordered by a 128-bit key, a hash of the text and then one of the id:
equal texts are neighbours.  A splitter moves by up to ``SNAP`` (0.5 %) of a
shard to leave equal texts together; only a group larger than that may be cut,
where equal sizes need it.  The splitters come from counting, not sampling: each round
sums the exact bytes below candidate key boundaries over all partitions and
narrows the interval of every splitter that is not settled by a factor of 64,
until each shard boundary lies within ``tolerance`` of its share (or a single
row is left).  A round reads a narrow table of keys and sizes.

A shard is cut into ranges of about ``RANGE`` bytes (or more, from ``RANGES``
ranges on), so that neither a shard nor its numbering needs one task: the rows are exchanged once, straight to
their range, and a row's slot is the rows of its shard's earlier ranges plus
its place in its own.  The driver holds a few numbers for each range; nearly
all ranges are settled by the first round's histogram.

Rows that agree in text and id (or have no id) share their key.  Only where a
splitter has to fall between such rows, the rows are written once with a
number of their own, which becomes the key's third part.

Defined cases: null texts are as good as empty and weigh one byte; equal rows
and rows without an id are split like any others; an empty table gives no
rows; columns named like the results are replaced, others pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, cut, given_back

SHARDS = 16
#: Bytes of a range, and ranges at most: beyond, ranges grow, so that neither the driver's histogram nor the exchange's blocks do.
RANGE, RANGES = 128 << 20, 32_768
#: Bits of the first histogram at least, its intervals for each range, and bits of a later round.
FIRST_BITS, FINENESS, MORE_BITS = 12, 4, 6
#: Bits of the key that equal texts share, and the part of a shard by which a splitter may move to leave them together.
TEXT_BITS, SNAP = 64, 0.005
LOW, HIGH = -(2**63), 2**63 - 1
KEY = ("_hi", "_lo", "_at")
RESULTS = ("size", "shard", "slot")

Key = tuple[int, int, int]


def keyed(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """Add the key (signed order) and size; its third part tells equal rows apart if they have numbers."""
    t = F.coalesce(F.col(text), F.lit(""))
    at = F.xxhash64("_row") if "_row" in df.columns else F.lit(LOW)
    return df.withColumns({"_hi": F.xxhash64(t), "_lo": F.xxhash64(F.col(row_id).cast("string"), F.lit(1)), "_at": at, "size": (F.octet_length(t) + 1).cast("long")})


def _taken(bits: int) -> list[int]:
    """How many bits of each part of the key a prefix has."""
    return [min(max(bits - 64 * n, 0), 64) for n in range(len(KEY))]


def _prefix(bits: int) -> list[Column]:
    return [F.lit(0).cast("long") if not b else F.shiftright(w, 64 - b) for w, b in zip(KEY, _taken(bits), strict=True)]


def _edge(prefix: Key, bits: int) -> Key:
    """The least key with that prefix."""
    return tuple(p << (64 - b) if b else LOW for p, b in zip(prefix, _taken(bits), strict=True))


def _outer(prefix: Key, bits: int, less: int) -> Key:
    """The prefix of ``less`` bits that holds this one."""
    return tuple(e >> (64 - b) if b else 0 for e, b in zip(_edge(prefix, bits), _taken(less), strict=True))


def _after(prefix: Key, bits: int) -> Key:
    """The least key behind those with the prefix."""
    whole = 0
    for e in _edge(prefix, bits):
        whole = (whole << 64) + (e - LOW)
    whole += 1 << (64 * len(KEY) - bits)
    if whole >> 64 * len(KEY):
        return (HIGH,) * len(KEY)
    return tuple((whole >> 64 * n & (2**64 - 1)) + LOW for n in reversed(range(len(KEY))))


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001, numbered: bool = False) -> tuple[list[Key], int, bool]:
    """Keys at which ranges begin (without the first), the ranges of a shard, and whether equal keys kept a splitter from its place.

    ``rows``: the key and size.  ``numbered``: equal rows have their own third part.
    """

    def counted(source: DataFrame, bits: int) -> pa.Table:
        """Prefix, bytes and rows of each interval that has any."""
        names = [c.alias(f"p{n}") for n, c in enumerate(_prefix(bits))]
        return source.groupBy(*names).agg(F.sum("size").alias("n"), F.count("*").alias("rows")).toArrow()

    total = rows.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, min(-(-total // (shards * RANGE)), RANGES // shards))
    parts, most = shards * per_shard, 192 if numbered else 128
    bits = max(FIRST_BITS, (FINENESS * parts - 1).bit_length())
    first = counted(rows, bits).sort_by("p0")  # one row an interval: the driver's share of a range
    if not total:
        return [], per_shard, False
    prefix, n, inside_rows = (first.column(c).to_numpy() for c in ("p0", "n", "rows"))
    upto = np.cumsum(n)
    want = total * np.arange(1, parts) / parts
    is_shard = np.arange(1, parts) % per_shard == 0
    slack = np.where(is_shard, tolerance * total / shards, 0.5 * total / parts)
    snap = np.maximum(slack, SNAP * total / shards)
    at = np.minimum(np.searchsorted(upto, want, "right"), len(n) - 1)
    below = upto[at] - n[at]
    before, behind = want - below <= slack, upto[at] - want <= slack
    done: dict[int, Key] = {}
    open_: dict[int, tuple[int, Key]] = {}  # splitter -> bytes below its interval, and the interval's prefix
    for j, a, b, c, low in zip(range(1, parts), at.tolist(), before.tolist(), behind.tolist(), below.tolist(), strict=True):
        p = (int(prefix[a]), 0, 0)
        if b:
            done[j] = _edge(p, bits)
        elif c:
            done[j] = _after(p, bits)
        else:
            open_[j] = low, p
    stuck = False
    while open_:
        held, old = sorted({p for _, p in open_.values()}), bits
        bits = min(bits + MORE_BITS, most if bits >= TEXT_BITS else TEXT_BITS)
        # One row for each open splitter at most; nothing of the rows themselves.
        names = rows.sparkSession.createDataFrame(held, "h0 long, h1 long, h2 long")
        same = [c == F.col(f"h{n}") for n, c in enumerate(_prefix(old))]
        groups: dict[Key, list[tuple[Key, int, int]]] = {}
        for r in counted(rows.join(F.broadcast(names), same[0] & same[1] & same[2]).select(*KEY, "size"), bits).to_pylist():
            p = (r["p0"], r["p1"], r["p2"])
            groups.setdefault(_outer(p, bits, old), []).append((p, r["n"], r["rows"]))
        for j, (low, p) in list(open_.items()):
            goal, free = float(want[j - 1]), float((snap if bits == TEXT_BITS else slack)[j - 1])
            for p, size, count in sorted(groups[p]):  # noqa: B020
                if low + size > goal:
                    break
                low += size
            else:  # rounding: the goal is the interval's end
                done[j] = _after(p, bits)
                del open_[j]
                continue
            if goal - low <= free:
                done[j] = _edge(p, bits)
            elif low + size - goal <= free:
                done[j] = _after(p, bits)
            elif count == 1 or bits == most:  # nothing left to divide: the nearer side
                stuck |= count > 1
                done[j] = _edge(p, bits) if goal - low <= low + size - goal else _after(p, bits)
            else:
                open_[j] = low, p
                continue
            del open_[j]
    edges, least = [], (LOW,) * len(KEY)
    for j in range(1, parts):
        least = max(least, done[j])
        edges.append(least)
    return edges, per_shard, stuck


def places(words: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted edges are no greater than each key; both as one array for each part of the key."""
    found = np.searchsorted(edges[0], words[0], "left")
    upto = np.searchsorted(edges[0], words[0], "right")
    if len(words) == 1:
        return upto
    tied = np.flatnonzero(upto > found)
    begin = found[tied]
    for a in np.unique(begin).tolist():
        own = tied[begin == a]
        b = int(upto[own[0]])
        found[own] = a + places([w[own] for w in words[1:]], [e[a:b] for e in edges[1:]])
    return found


def _range_of(edges: list[Key], bases: list[int] | None = None):
    """The range of a key, and the rows of its shard's earlier ranges."""
    columns = [np.array([e[n] for e in edges], np.int64) for n in range(len(KEY))]
    base = np.array(bases if bases is not None else [0] * (len(edges) + 1), np.int64)

    @F.arrow_udf("struct<part:int,base:long>")
    def part(hi: pa.Array, lo: pa.Array, at: pa.Array) -> pa.Array:
        found = places([w.to_numpy(zero_copy_only=False) for w in (hi, lo, at)], columns)
        return pa.StructArray.from_arrays([pa.array(found.astype(np.int32)), pa.array(base[found])], ["part", "base"])

    return part(*KEY)


def shard(df: DataFrame, shards: int = SHARDS, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """All rows and columns of ``df``, exchanged to their ranges and sorted there, with size, shard and slot."""
    kept = [c for c in df.columns if c not in RESULTS]
    read = lambda d, *more: d.select(carried(kept).alias("own"), F.col(text).alias("text"), F.col(row_id).alias("row_id"), *more)
    rows = read(df)
    narrow = cut(keyed(rows, "text", "row_id").select(*KEY, "size"))
    edges, per_shard, stuck = splitters(narrow, shards)
    if stuck:
        number = "_" * (1 + max(map(len, df.columns))) + "row"
        rows = read(cut(df.withColumn(number, F.monotonically_increasing_id())), F.col(number).alias("_row"))
        narrow = cut(keyed(rows, "text", "row_id").select(*KEY, "size"))
        edges, per_shard, _ = splitters(narrow, shards, numbered=True)
    counts = {r["p"]: r["n"] for r in narrow.groupBy(_range_of(edges)["part"].alias("p")).agg(F.count("*").alias("n")).collect()}
    bases, base = [], 0
    for p in range(len(edges) + 1):
        base = 0 if p % per_shard == 0 else base
        bases.append(base)
        base += counts.get(p, 0)
    rows = keyed(rows, "text", "row_id").withColumn("_to", _range_of(edges, bases)).drop("text")
    rows = rows.repartitionById(len(edges) + 1, F.col("_to.part")).sortWithinPartitions(*KEY, "row_id")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return rows.withColumn("slot", place + F.col("_to.base")).select(*given_back(kept, "own"), "size", F.floor(F.col("_to.part") / per_shard).cast("int").alias("shard"), "slot")

"""Near-duplicate documents by b-bit MinHash, links confirmed on full shingle sets.

1. Each text becomes the set of its 5-word shingles (A-Z lower-cased; words are
   runs of other than white space; shorter texts are one shingle).  A document
   keeps the set's size, a digest of the set, ``BANDS`` band keys over
   ``BANDS * ROWS`` minima, and a signature of the low ``BITS`` bits of each
   minimum, packed.
2. Equal sets are one class, linked through its smallest id; only classes go on.
3. Classes that share a band key are candidates.  In each bucket the
   similarity of two signatures is estimated by counting equal fields, less
   the share that collides by chance, and classes whose estimate reaches
   ``LENIENT`` are joined by a spanning forest: at most one row a class, never
   all pairs.  ``LENIENT`` lies five standard deviations below the threshold.
4. The forests' components are clusters that hold every link between them.
   Each cluster's texts meet; a search that starts from one document, takes
   all unvisited ones with exact Jaccard similarity of at least 0.75 as linked,
   and goes on from those, gives the exact components.
5. Buckets and clusters beyond ``GROUP`` members are cut into parts by a hash.
   Each part meets a few representatives of the whole group, which link the
   parts that hold copies of one text to each other.  Members that this leaves
   apart from the first representative's component (none, where all are copies
   of one text) then visit every other part, ``GROUP`` at a time: every two
   members have met, or are linked through others, and no task holds more than
   a part and as many visitors.

A pair at the threshold shares no band with probability (1 - .75**4)**32,
about 5 in a million, and its estimate misses ``LENIENT`` with about 0.8 in a
million (a binomial tail, not conditioned on a shared band); a pair that is
more similar is missed less.  Such a pair is lost only if no third text joins
its two.  What follows the candidates is exact.

Defined cases: null texts and texts without words have an empty set and are
linked with nothing; rows with a null id take no part and have a null
component; repeated rows share their id's component; further columns, whatever
their names, are not read, and the result has its own four alone; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .wordbpe import runs

SHINGLE = 5
BANDS, ROWS, BITS = 32, 4, 4
LENIENT = 0.55
#: Members of a part, and representatives that each part of a group meets.
GROUP, REPS = 512, 8
#: Copies of a set from which on its class is looked up with a salted key, and the salts.
MANY, SALTS = 10_000, 16
#: Buckets are counted on a part of the classes, to find those that need cells.
SAMPLE = 16
#: Bytes of text hashed at once: some thirty times as many are in use meanwhile.
RUN = 1 << 19

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = _rng.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)
MULTIPLY = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64)
FIELDS = np.uint64(0x1111111111111111)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's begin (one more than texts)."""
    joined = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    gap = SPACE[joined]
    edge = np.diff(np.r_[True, gap].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(BYTE[joined] * up[:-1], out=total[1:])
    words = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(start, limits)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    n = max(len(words) - SHINGLE + 1, 0)
    windows = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        windows += words[k : k + n] * PLACE[k]
    windows = mixed(windows)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            whole = (words[a:b] * PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(x: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(x), 2048):
        rows = x[k : k + 2048, None] * MULTIPLY + ADD
        np.minimum(least, (rows ^ (rows >> np.uint64(32))).min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> bytes:
    """The low BITS bits of the minima, 16 fields a word."""
    fields = (mixed(least) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(fields << shifts, axis=1).astype("<u8").tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(31) + rows[:, k])
    return key.view(np.int64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of a signature to each of ``many``, by counting bits."""
    x = many ^ one
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & FIELDS).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - differ / (BANDS * ROWS) - chance) / (1 - chance)


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > RUN:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "digest", "bands", "signature"]
    for batch in batches:
        for a, b in runs(batch.column("text"), RUN):
            sizes, digests, keys, signatures = [], [], [], []
            for x in shingles(_bytes(batch.column("text").slice(a, b - a))):
                sizes.append(len(x))
                if not len(x):
                    digests.append(None), keys.append(None), signatures.append(None)
                    continue
                least = minima(x)
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                keys.append(bands(least))
                signatures.append(packed(least))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names)


def sketch(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary")


def forest(n: int, linked) -> list[tuple[int, int]]:
    """Tree edges (root, member) of a graph on n nodes; ``linked(i, rest)`` masks the neighbours of i in ``rest``.

    A root is its component's first node: with nodes in id order, buckets that
    hold the same classes give the same edges, which count once.
    """
    edges, rest = [], np.arange(n)
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        open_ = [root]
        while open_ and len(rest):
            mask = linked(open_.pop(), rest)
            hit = rest[mask]
            if len(hit):
                rest = rest[~mask]
                edges += [(root, int(j)) for j in hit]
                open_ += hit.tolist()
    return edges


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Groups of at least two rows, of rows that come sorted by ``by`` (whole numbers)."""
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if carried is not None:
            batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in by:
            change |= np.diff(batch.column(c).to_numpy()) != 0
        start = np.concatenate([[0], np.flatnonzero(change) + 1])
        size = np.diff(start)
        some = size > 1
        for s, n in zip(start[:-1][some].tolist(), size[some].tolist(), strict=True):
            yield batch.slice(s, n)
        carried = batch.slice(int(start[-1]))
    if carried is not None and carried.num_rows > 1:
        yield carried


MET = "a long, b long, key long"


def _met(payload: str, links_of, apart: bool):
    """Forest edges (a, b) of each cell; ``links_of`` the members' payloads gives ``linked`` for :func:`forest`.

    Rows come sorted by key, cell and doc_id.  ``apart``: of the groups that are
    cut up, also the members (a, and the key) that are not in the component of
    the first row, which every cell of a group has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int | None, int | None]] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["a", "b", "key"])
            found.clear()
            return made

        for group in _grouped(batches, ["key", "i", "j"]):
            ids, payloads = group.column("doc_id").to_pylist(), group.column(payload).to_pylist()
            cut_up = group.column("cut")[0].as_py()
            if cut_up:  # a representative or visitor may be at home here too
                ids, payloads = map(list, zip(*dict.fromkeys(zip(ids, payloads, strict=True)), strict=True))
            edges = forest(len(ids), links_of(payloads))
            found += [(ids[p], ids[q], None) for p, q in edges]
            if apart and cut_up:
                near, key = {0, *(q for p, q in edges if p == 0)}, group.column("key")[0].as_py()
                found += [(ids[n], None, key) for n in range(len(ids)) if n not in near]
            if len(found) > 50_000:
                yield out()
        yield out()

    return run


def _estimated(signatures: list[bytes]):
    signs = np.frombuffer(b"".join(signatures), "<u8").reshape(len(signatures), -1)
    return lambda i, rest: estimate(signs[i], signs[rest]) >= LENIENT


def _exact(texts: list[str]):
    raw = [t.encode() for t in texts]
    return exact_links([x for a, b in _runs(raw) for x in shingles(raw[a:b])])


def exact_links(sets: list[np.ndarray]):
    """``linked`` for :func:`forest`: exact Jaccard similarity of at least 0.75."""
    size = np.array([len(s) for s in sets])
    flat, at = np.concatenate(sets), np.r_[0, np.cumsum(size)]
    codes = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(codes.max() + 1 if len(codes) else 0, np.int64)

    def linked(i: int, rest: np.ndarray) -> np.ndarray:
        fit = (size[rest] * 4 >= size[i] * 3) & (size[rest] * 3 <= size[i] * 4)
        near = rest[fit]
        if not len(near):
            return fit
        own = codes[at[i] : at[i + 1]]
        mark[own] = 1
        hits = np.concatenate([codes[at[j] : at[j + 1]] for j in near.tolist()])
        starts = np.r_[0, np.cumsum(size[near])[:-1]]
        common = np.add.reduceat(mark[hits], starts)
        mark[own] = 0
        ok = 100 * common >= 75 * (size[i] + size[near] - common)
        out = np.zeros(len(rest), bool)
        out[np.flatnonzero(fit)[ok]] = True
        return out

    return linked


def meetings(rows: DataFrame, sizes: DataFrame, payload: str, links_of) -> DataFrame:
    """Edges (a, b) that hold each group's components.  ``rows``: key, doc_id, payload; ``sizes``: key and parts (over 1) of groups that are cut up."""
    sizes = cut(sizes)  # read back, its size is known: Spark broadcasts it only if that is small
    order = ["key", "i", "j", "doc_id"]
    own = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("parts")), F.lit(0)).cast("int")
    home = cut(rows.join(sizes, "key", "left").select("key", "parts", own.alias("i"), "doc_id", payload))
    large = home.where("parts is not null")
    here = home.select("key", "i", F.lit(0).alias("j"), "doc_id", F.col("parts").isNotNull().alias("cut"), payload)
    # Representatives: the least id, which all cells of the group see first, and the least by some hashes.
    least = [F.min(F.struct(F.xxhash64("doc_id", F.lit(n)), "doc_id"))["doc_id"] for n in range(1, REPS)]
    reps = large.groupBy("key").agg(F.array_distinct(F.array(F.min("doc_id"), *least)).alias("ids"))
    reps = cut(reps.select("key", F.explode("ids").alias("doc_id")))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i")
    sent = large.join(reps, ["key", "doc_id"]).select("key", everywhere, F.lit(0).alias("j"), "doc_id", F.lit(True).alias("cut"), payload)
    first = here.unionByName(sent).repartition("key", "i", "j").sortWithinPartitions(*order).mapInArrow(_met(payload, links_of, True), MET)
    first = cut(first)
    left = first.where("b is null").select("key", F.col("a").alias("doc_id")).distinct()
    edges = first.where("b is not null").select("a", "b")
    if left.isEmpty():
        return edges
    # Those apart visit the other parts, in as many turns as they fill.
    turns = left.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("turns"))
    at = large.join(cut(turns), "key")
    hosts = at.select("key", "i", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("j"), "doc_id", F.lit(True).alias("cut"), payload)
    turn = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.col("turns")).cast("int").alias("j")
    guests = at.join(cut(left), ["key", "doc_id"]).select("key", everywhere, turn, "doc_id", F.lit(True).alias("cut"), payload)
    again = hosts.unionByName(guests).repartition("key", "i", "j").sortWithinPartitions(*order).mapInArrow(_met(payload, links_of, False), MET)
    return edges.unionByName(cut(again).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for the nodes of ``edges`` (a, b).

    Each round gives every node the least root among its neighbours and then
    that root's own root; no part of the graph leaves the executors.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        hooked = state.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        hooked = cut(hooked)
        up = hooked.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        jumped = cut(hooked.join(up, F.col("root") == F.col("n2"), "left").select("node", "old", F.least("root", F.coalesce("r2", "root")).alias("root")))
        changed = jumped.where("old <> root").limit(1).count()
        state = jumped.select("node", "root")
        if not changed:
            return state


def near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    known = cut(sketch(docs, text, row_id))
    with_set = known.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(with_set.groupBy("digest").agg(F.min(F.struct("doc_id", "bands", "signature")).alias("r"), F.count("*").alias("copies")).select("digest", "r.*", "copies"))
    banded = classes.select(F.explode("bands").alias("key"), "doc_id", "signature")
    seen = classes.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(F.explode("bands").alias("key")).groupBy("key").count()
    hot = seen.where(F.col("count") * SAMPLE > GROUP).select("key", (F.ceil(F.col("count") * SAMPLE / GROUP) + 1).cast("int").alias("parts"))
    edges = meetings(banded, hot, "signature", _estimated)
    coarse = components(cut(edges.distinct())).select(F.col("node").alias("doc_id"), F.col("root").alias("key"))
    sizes = coarse.groupBy("key").count().where(F.col("count") > GROUP).select("key", (F.ceil(F.col("count") / GROUP) + 1).cast("int").alias("parts"))
    texts = docs.select(F.col(row_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    met = texts.join(coarse, F.col("_id") == F.col("doc_id")).select("key", "doc_id", "text")
    exact = components(cut(meetings(met, sizes, "text", _exact)))
    root = classes.join(exact, F.col("doc_id") == F.col("node"), "left").select(F.col("digest").alias("_d"), F.coalesce("root", "doc_id").alias("root"), "copies")
    # Copies of one set may be a third of all rows: the classes of such are looked up with the key salted.
    many = cut(classes.where(F.col("copies") > MANY).select(F.col("digest").alias("_m")))
    salts = F.when(F.col("copies") > MANY, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    root = root.withColumn("_salt", F.explode(salts)).drop("copies")
    salt = F.when(F.col("_m").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")
    salted = known.select("doc_id", "n_shingles", "digest").join(many, F.col("digest") == F.col("_m"), "left").withColumn("salt", salt)
    out = salted.join(root, (F.col("digest") == F.col("_d")) & (F.col("salt") == F.col("_salt")), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each group; rows that repeat an id and its text count once, rows without an id stay."""
    found = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.join(found, F.col("doc_id") == F.col("_id"), "left_semi")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if again:
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        rows = rows.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_o")).select(*[F.col(f"_o.{c}") if c in others else F.col(c) for c in docs.columns]) if others else rows.distinct()
    return rows.unionByName(docs.where("doc_id is null"))

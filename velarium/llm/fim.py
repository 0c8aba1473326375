"""Fill-in-middle transformation over a distinct-text index.

Documents with identical texts share one entry of the index.  An entry holds
the text and its token boundaries (ends, in code points) as an Elias-Fano
list: low bits packed side by side, high bits in unary, so a boundary is
selected without decoding the others.  Texts are dealt by a content key (two
digests and the length), grouped by the text itself, and encoded once; the
documents' narrow rows (all columns but the text) are then joined to the
entries by that key, and each selects its own two boundaries.  Texts are exchanged
once, and go to Python once for each entry; only the lists are exchanged again.

A text with more copies than ``COPIES`` (or than a quarter of a partition's
share of rows) gets an entry for each such number of copies, dealt out by a
hash of the row, so that no task holds more of a hot text's documents.

Output, by seeded hashes of the document's id: plain, psm or spm (see
:func:`transformed`).  ``restored`` takes it apart by its markers again.

Defined cases: null texts are empty; an empty text, and one that holds a
marker, stays plain; a null id is hashed as the empty string; equal rows give
equal results, each its own; columns named like the results are replaced,
others pass; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import carried, cut, given_back

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages: documents that are transformed, and of those the ones with the suffix first.
RATE, SPM = 50, 80
COPIES = 1024
#: Bytes of text that a partition should have, and the most partitions.
SHARE, MOST = 256 << 20, 50_000
#: Characters looked at once.
RUN = 1 << 20
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def boundaries(text: str) -> np.ndarray:
    """Ends of the tokens, in code points: a token is white space and the word behind it, or white space at the end."""
    ends, word = [], False
    for k in range(0, len(text), RUN):
        part = np.frombuffer(text[k : k + RUN].encode("utf-32-le", "surrogatepass"), np.uint32)
        words = (part != 32) & ((part < 9) | (part > 13))
        before = np.r_[word, words[:-1]]
        ends.append(np.flatnonzero(before & ~words) + k)
        word = bool(words[-1])
    if text:
        ends.append(np.array([len(text)]))
    return np.concatenate(ends) if ends else np.empty(0, np.int64)


def elias_fano(values: np.ndarray, universe: int) -> bytes:
    """Rising numbers up to ``universe``: count and universe, low bits, then high bits in unary."""
    n = len(values)
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    v = values.astype(np.uint64)
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    high = np.zeros(n + (universe >> low) + 1, np.uint8)
    high[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    return struct.pack("<QQ", n, universe) + np.packbits(bits.reshape(-1), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(data: bytes, k: int) -> int:
    """The k-th number (from 0) of an Elias-Fano list."""
    n, universe = struct.unpack_from("<QQ", data)
    low = max(0, (universe // n).bit_length() - 1)
    lows = 16 + (n * low + 7) // 8
    at, value = k * low, 0
    if low:
        first, last = 16 + at // 8, 16 + (at + low + 7) // 8
        value = int.from_bytes(data[first:last], "little") >> at % 8 & (1 << low) - 1
    high = np.frombuffer(data, np.uint8, offset=lows)
    upto = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    byte = int(np.searchsorted(upto, k + 1))
    inside = k - (int(upto[byte - 1]) if byte else 0)
    bit = int(np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))[inside])
    return (byte * 8 + bit - k << low) + value


_long = lambda name: StructField(name, LongType())


@F.arrow_udf(StructType([_long("n"), StructField("ends", BinaryType())]))
def _listed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        counts, lists = [], []
        for text in batch:
            t = text.as_py()
            ends = boundaries(t)
            counts.append(len(ends))
            lists.append(elias_fano(ends, len(t)))
        yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(lists, pa.binary())], ["n", "ends"])


@F.arrow_udf(StructType([_long("prefix"), _long("middle")]))
def _cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for lists, firsts, lasts in batches:
        rows = []
        for data, a, b in zip(lists, firsts.to_pylist(), lasts.to_pylist(), strict=True):
            if a is None:
                rows.append((None, None))
                continue
            raw = data.as_py()
            start, stop = (select(raw, k - 1) if k else 0 for k in (a, b))
            rows.append((start, stop - start))
        yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], ["prefix", "middle"])


def _key(text: Column) -> Column:
    return F.concat(F.unhex(F.sha2(text, 256)), F.unhex(F.hex(F.xxhash64(text))), F.unhex(F.hex(F.octet_length(text))))


def _draw(doc_id: Column, seed: int, number: int) -> Column:
    """The number-th group (from 1) of 8 digits of the seeded hash, as an unsigned integer."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(name, 8 * number - 7, 8), 16, 10).cast("long")


def transformed(df: DataFrame, seed: int = 42, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all but the text) of every document with n, form, prefix_chars, middle_chars and output.

    With h1 to h4 from the seeded hash of the id and n tokens, the prefix ends
    after the smaller of h1 and h2 mod (n + 1) tokens and the middle after the
    larger.  A document is transformed if h3 mod 100 < RATE, into ``<S>``suffix
    ``<P>``prefix``<M>``middle (spm) if h4 mod 100 < SPM, else into ``<P>``
    prefix``<S>``suffix``<M>``middle (psm).
    """
    kept = [c for c in columns or df.columns if c not in (*RESULTS, "text")]
    text, h = F.coalesce(F.col("text"), F.lit("")), F.xxhash64("doc_id")
    docs = cut(df.select(carried(kept).alias("own"), F.col("doc_id").cast("string").alias("id"), _key(text).alias("key"), F.octet_length(text).cast("long").alias("bytes"), h.alias("h")))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, min(MOST, -(-size // SHARE)))
    limit = max(COPIES, rows // (4 * parts))
    # Fewer than 4 * parts keys, so at most a few MB.
    hot = F.broadcast(cut(docs.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count("*") / limit).alias("salts")).where("salts > 1")))
    salted = lambda d: d.join(hot, F.col("key") == F.col("_key"), "left").withColumn("salt", F.coalesce(F.pmod("h", "salts"), F.lit(0)))
    texts = salted(df.select(text.alias("text"), _key(text).alias("key"), h.alias("h"))).select("key", "salt", "text")
    entries = texts.repartition(parts, "key", "salt").dropDuplicates(["key", "salt", "text"])
    # Python gives up a partitioning: only its lists are dealt by the key again, the texts stay where they are.
    lists = entries.select("key", "salt", _listed(F.col("text")).alias("list")).select(F.col("key").alias("_of"), F.col("salt").alias("_salt"), "list.n", "list.ends")
    own = salted(docs).select("own", "id", F.col("key").alias("_like"), F.col("salt").alias("_part"))
    d = entries.join(lists.hint("shuffle_hash"), (F.col("key") == F.col("_of")) & (F.col("salt") == F.col("_salt")))
    d = d.join(own.hint("shuffle_hash"), (F.col("key") == F.col("_like")) & (F.col("salt") == F.col("_part")))
    marker = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marker = marker | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marker | (_draw(F.col("id"), seed, 3) % 100 >= RATE)
    d = d.withColumn("form", F.when(plain, "plain").when(_draw(F.col("id"), seed, 4) % 100 < SPM, "spm").otherwise("psm"))
    a, b = (_draw(F.col("id"), seed, i) % (F.col("n") + 1) for i in (1, 2))
    moved = F.col("form") != "plain"
    d = d.withColumn("at", _cut(F.col("ends"), F.when(moved, F.least(a, b)), F.when(moved, F.greatest(a, b))))
    p, m = F.col("at.prefix").cast("int"), F.col("at.middle").cast("int")
    prefix, middle = F.substring("text", F.lit(1), p), F.substring("text", p + 1, m)
    suffix = F.substring("text", p + m + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return d.select(*given_back(kept, "own"), "n", "form", F.col("at.prefix").alias("prefix_chars"), F.col("at.middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone."""
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third = F.instr(output, MIDDLE)
    one, two = F.substring(output, F.lit(4), second - 4), F.substring(output, second + 3, third - second - 3)
    three = F.substring(output, third + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))

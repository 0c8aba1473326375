"""Best-fit packing by bin-completion branch and bound.

Documents are encoded, ended with an end id and, only where longer than a
sequence, cut into sequence-long pieces.  Full pieces are sequences of their
own and take no part in the search.  The others meet in blocks of about
``BLOCK`` pieces by a hash of their place; a block is packed by best-fit
decreasing, and where that needs more sequences than the bound on its tokens
allows, by bin completion: first what best fit left in sequences with room is
packed anew, each time the largest piece with its fullest filling; if the bound
is still missed, a search goes through the undominated fillings around the
largest piece left, fullest first, and leaves a branch when its wasted room
exceeds what an improvement could afford.  Finding the fewest sequences is
NP-hard: the search ends after ``EFFORT`` steps, some ten times what a first
complete packing of a block takes, and the best packing so far stands.

Each block gathers the room it leaves in few sequences.  The pieces of all
sequences with room are dealt into blocks again, as many as they need, and
packed anew, round by round, until one block holds them all or a round does
with no fewer sequences.

Defined cases: null and empty texts give a piece of the end id alone; repeated
rows, also without an id, are pieces of their own and spread over the blocks;
further columns, whatever their names, are not read; an empty table gives no
pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .wordbpe import encoder, runs

LENGTH = 4096
#: Pieces of a block, and steps of the search in it (a step takes or passes over a piece).
BLOCK, EFFORT = 4096, 200_000
#: Partitions at most: beyond, a task packs several blocks, one after another.
MOST_TASKS = 20_000


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Best-fit decreasing; bins of positions."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(free, (lengths[i], -1))
        if at == len(free):
            bins.append([i])
            left, b = room - lengths[i], len(bins) - 1
        else:
            left, b = free.pop(at)
            bins[b].append(i)
            left -= lengths[i]
        if left:
            insort(free, (left, b))
    return bins


def least_bins(lengths: list[int], room: int) -> int:
    """A lower bound: the tokens, and, for every k, the pieces longer than half a sequence with what of at least k cannot join them."""
    ranked = np.sort(np.array(lengths, np.int64))
    upto = np.concatenate([[0], np.cumsum(ranked)])
    k = np.unique(ranked[ranked <= room // 2])
    half, fits, least = np.searchsorted(ranked, room // 2, "right"), np.searchsorted(ranked, room - k, "right"), np.searchsorted(ranked, k)
    mid = fits - half
    short = upto[half] - upto[least] - (mid * room - (upto[fits] - upto[half]))
    bounds = len(ranked) - half + np.maximum(0, -(-short // room))
    return max(int(-(-upto[-1] // room)), int(bounds.max(initial=len(ranked) - half)))


def fillings(sizes: list[int], room: int, effort: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from the descending sizes, as positions: lazily, fullest first.

    Suffix sums say which totals the sizes from a position on can make, so no
    path ends without a filling.  A filling leaves out no piece that would fit
    and none that could take a smaller one's place.  Among equal sizes the
    first are taken.  Each step lowers ``effort[0]``; at 0 the fillings end.
    """
    n, down = len(sizes), lambda x: -x
    mask = (1 << (room + 1)) - 1
    sums, top = [1], n  # sums[i - top]: totals of sizes[i:]; above top all totals can be made
    while top and sizes[top - 1] <= room and sums[-1] != mask:
        now = (sums[-1] | sums[-1] << sizes[top - 1]) & mask
        if now == sums[-1]:  # more of this size add nothing either
            at = bisect_left(sizes, -sizes[top - 1], key=down)
            sums += sums[-1:] * (top - at)
            top = at
        else:
            sums.append(now)
            top -= 1
    sums.reverse()
    full = sums[0] == mask
    lowest = bisect_left(sizes, -room, key=down)  # the first that fits at all

    def makes(at: int, total: int) -> bool:
        return full if at < top else bool(sums[at - top] >> total & 1)

    totals = mask if lowest < top else sums[lowest - top]
    while totals:
        total = totals.bit_length() - 1
        totals ^= 1 << total
        left, open_, taken = room - total, [], []
        i, s = lowest, total
        while True:
            effort[0] -= 1
            if effort[0] <= 0:
                return
            if s:
                i = bisect_left(sizes, -s, lo=i, key=down)
                if i < n and makes(i, s):
                    j = bisect_right(sizes, -sizes[i], lo=i, key=down)
                    if makes(i + 1, s - sizes[i]):
                        if makes(j, s):
                            open_.append((j, s, len(taken)))
                        taken.append(i)
                        s -= sizes[i]
                        i += 1
                    else:
                        i = j
                    continue
            elif not _dominated(sizes, taken, left):
                yield tuple(taken)
            if not open_:
                break
            i, s, k = open_.pop()
            del taken[k:]


def _dominated(sizes: list[int], taken: list[int], left: int) -> bool:
    """Whether an unused piece fits in what is left, alone or in the place of a smaller one."""
    if not left:
        return False
    used = set(taken)
    for size in (0, *(sizes[t] for t in taken)):
        # The smallest unused piece that is larger than this one.
        j = bisect_left(sizes, -size, key=lambda x: -x) - 1
        while j >= 0 and j in used:
            j -= 1
        if j >= 0 and sizes[j] - size <= left:
            return True
    return False


def tightened(bins: list[list[int]], lengths: list[int], room: int) -> list[list[int]]:
    """The pieces of bins with room packed anew, each time the largest with its fullest filling; never more bins."""
    full = [b for b in bins if sum(lengths[i] for i in b) == room]
    loose = sorted((i for b in bins if sum(lengths[i] for i in b) < room for i in b), key=lambda i: -lengths[i])
    sizes, anew = [lengths[i] for i in loose], []
    while loose:
        first, left = loose.pop(0), room - sizes.pop(0)
        # The fullest filling is never dominated, so the first one found is taken: no effort limits it.
        pick = next(fillings(sizes, left, [1 << 62]))
        anew.append([first, *(loose[j] for j in pick)])
        for j in reversed(pick):
            del loose[j], sizes[j]
    return full + anew if len(full) + len(anew) <= len(bins) else bins


def complete(lengths: list[int], room: int, effort: int = EFFORT) -> list[list[int]]:
    """As few bins as the search finds; never more than best fit gives."""
    if room in lengths:  # full pieces are bins of their own and take no part
        parts = [i for i, n in enumerate(lengths) if n < room]
        return [[i] for i, n in enumerate(lengths) if n == room] + [[parts[i] for i in b] for b in complete([lengths[i] for i in parts], room, effort)]
    incumbent = best_fit(lengths, room)
    bound = least_bins(lengths, room)
    if len(incumbent) > bound:
        incumbent = tightened(incumbent, lengths, room)
    if len(incumbent) <= bound:
        return incumbent
    left = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    sizes = [lengths[i] for i in left]
    total, budget = sum(sizes), [effort]
    # One entry a bin: its fillings, its pieces in order of position, and the room wasted up to it.
    done: list[list] = []
    wasted = 0

    def opened() -> None:
        """Start a bin around the largest piece left."""
        first, size = left.pop(0), sizes.pop(0)
        done.append([first, size, fillings(sizes, room - size, budget), (), [], wasted])

    opened()
    while done and budget[0] > 0 and len(incumbent) > bound:
        first, size, more, pick, pieces, before = done[-1]
        for j, i in zip(pick, pieces):  # ascending, so each returns to its place
            left.insert(j, i)
            sizes.insert(j, lengths[i])
        pick = next(more, None)
        # Room that may be wasted in all, if one bin fewer than the incumbent is to do; fillings come fullest first.
        lost = room - size - sum(sizes[j] for j in pick) if pick is not None else 0
        if pick is None or before + lost > (len(incumbent) - 1) * room - total:
            left.insert(0, first)
            sizes.insert(0, size)
            done.pop()
            continue
        done[-1][3:5] = pick, [left[j] for j in pick]
        for j in reversed(pick):
            del left[j], sizes[j]
        wasted = before + lost
        if left:
            opened()
        elif len(done) < len(incumbent):
            incumbent = [[d[0], *d[4]] for d in done]
    return incumbent


def _piece_udf(tokenizer: str, end_id: int, length: int):
    @F.arrow_udf("array<struct<piece:long,start:long,length:long,ids_crc32:long>>")
    def pieces(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = encoder(tokenizer)
        for batch in texts:
            made = [_cut_up(*codec.encode(batch.slice(a, b - a)), end_id, length) for a, b in runs(batch)]
            yield pa.concat_arrays(made) if made else pa.array([], KIND)

    return pieces


FIELDS = ("piece", "start", "length", "ids_crc32")
KIND = pa.list_(pa.struct([(c, pa.int64()) for c in FIELDS]))


def _cut_up(ids: np.ndarray, ends: np.ndarray, end_id: int, length: int) -> pa.Array:
    """The pieces of each document, whose ids end there and get the end id behind them."""
    flat = memoryview(np.insert(ids, ends, end_id).astype("<u4").tobytes())
    ends = ends + np.arange(1, len(ends) + 1)
    size = np.diff(ends, prepend=0)
    n = -(-size // length)
    upto = np.cumsum(n)
    piece = np.arange(n.sum()) - np.repeat(upto - n, n)
    start = piece * length
    taken = np.minimum(np.repeat(size, n) - start, length)
    at = 4 * (np.repeat(ends - size, n) + start)
    crc = [zlib.crc32(flat[a:b]) for a, b in zip(at.tolist(), (at + 4 * taken).tolist(), strict=True)]
    rows = pa.StructArray.from_arrays([pa.array(piece), pa.array(start), pa.array(taken), pa.array(crc, pa.int64())], list(FIELDS))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), rows).cast(KIND)


def pieces(df: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    rows = df.select(F.col(row_id).alias("doc_id"), F.explode(_piece_udf(tokenizer, end_id, length)(F.coalesce(F.col(text), F.lit("")))).alias("p"))
    return rows.select("doc_id", "p.*")


def _packer(length: int):
    """Pack each block of a partition; rows come sorted by block.  Sequences with room are open."""

    def packed(block: int, rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[4]))
        sizes = [r[3] for r in rows]
        bins = tightened(complete(sizes, length), sizes, length)  # the room that is left, in few sequences
        out = []
        for n, b in enumerate(bins):
            at = 0
            room = length - sum(sizes[i] for i in b)
            for i in b:
                out.append((*rows[i], (block << 24) + n, at, room > 0))
                at += rows[i][3]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "doc_id", "piece", "start", "length", "ids_crc32")]
            for b, *row in zip(*columns, strict=True):
                if b != block and rows:
                    yield packed(block, rows)
                    rows = []
                block = b
                rows.append(tuple(row))
        if rows:
            yield packed(block, rows)

    return run


RESULT = "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Give every piece its sequence_id and offset."""
    left = loose = cut(parts.select("doc_id", "piece", "start", "length", "ids_crc32"))
    done, first, before = [], 0, None
    while True:
        blocks = max(1, -(-left.count() // BLOCK))
        # Blocks are numbered on from round to round, which keeps the sequence ids of different rounds apart.
        block = (F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(first)), F.lit(blocks)) + first).alias("block")
        dealt = left.select(block, "*").repartition(min(blocks, MOST_TASKS), "block").sortWithinPartitions("block")
        out = cut(dealt.mapInArrow(_packer(length), RESULT + ", open boolean"))
        sequences, opened = out.agg(F.count_if(F.col("offset") == 0), F.count_if(F.col("open") & (F.col("offset") == 0))).first()
        if before is not None and sequences > before:  # the round before did better
            done.append(loose)
            break
        last = blocks == 1 or sequences == before
        done.append(out.drop("open") if last else out.where(~F.col("open")).drop("open"))
        if last or not opened:
            break
        loose = out.where("open").drop("open")
        left, before, first = loose.drop("sequence_id", "offset"), opened, first + blocks
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole

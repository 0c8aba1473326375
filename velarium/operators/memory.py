"""Memory-system analytics: address mapping, energy from counters, and activation counters.

Exact counts are plain aggregations.  Counters with bounded state (a table that
spills over, a table that is pruned, group counters that fan out to rows) run
as one pass over each key's rows in order, or as windows where the state is a
running count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of an address, and their widths in bits; the row takes what is left.
FIELDS = ("channel", "rank", "bankgroup", "bank", "row_", "col")
WIDTHS = {"channel": 2, "rank": 1, "bankgroup": 2, "bank": 2, "row_": 14, "col": 6}
#: Fields from the lowest bits to the highest.
LAYOUTS = {
    "channel_top": ("col", "row_", "bank", "bankgroup", "rank", "channel"),
    "channel_low": ("channel", "col", "rank", "bankgroup", "bank", "row_"),
    "column_low": ("col", "channel", "rank", "bankgroup", "bank", "row_"),
    "column_top": ("channel", "rank", "bankgroup", "bank", "row_", "col"),
}


def _bits(x: Column, at: int, width: int) -> Column:
    return F.shiftright(x, at).bitwiseAND((1 << width) - 1)


def mapped(address: Column, layout: str, widths: dict[str, int] = WIDTHS) -> dict[str, Column]:
    """The fields of an address (a long, without the bits inside a transfer)."""
    out, at = {}, 0
    for name in LAYOUTS[layout]:
        out[name] = _bits(address, at, widths[name])
        at += widths[name]
    return out


def mapped_interleaved(address: Column, widths: dict[str, int] = WIDTHS, low: int = 2) -> dict[str, Column]:
    """Runs of 2**low columns, then the banks, the other columns and the row; banks are mixed with column bits."""
    out, at = {}, low
    for name in ("channel", "rank", "bankgroup", "bank"):
        out[name] = _bits(address, at, widths[name])
        at += widths[name]
    rest = widths["col"] - low
    out["col"] = _bits(address, 0, low) + F.shiftleft(_bits(address, at, rest), low)
    out["row_"] = F.shiftright(address, at + rest)
    used = 0
    for name in ("channel", "rank", "bankgroup", "bank"):
        out[name] = out[name].bitwiseXOR(_bits(out["col"], used, widths[name]))
        used += widths[name]
    return out


def indirected(df: DataFrame, table: DataFrame, bank: list[str]) -> DataFrame:
    """Rows looked up in an indirection table (bank columns, row_, to): swapped rows go elsewhere, others stay."""
    return df.join(table.withColumnRenamed("to", "_to"), [*bank, "row_"], "left").withColumn("row_", F.coalesce("_to", "row_")).drop("_to")


def translated(address: Column, page_bits: int, pages_bits: int, multiplier: int, shift: int) -> Column:
    """A physical address: the page number permuted among 2**pages_bits pages by an odd multiplier and a shift, the offset kept."""
    if multiplier % 2 == 0:
        raise ValueError("an even multiplier maps two pages to one")
    page = _bits(address, page_bits, pages_bits)
    to = F.pmod(page * multiplier + shift, F.lit(1 << pages_bits))
    return F.shiftleft(to, page_bits) + _bits(address, 0, page_bits)


def energy(counters: DataFrame, volts: dict[str, float], amps: dict[str, float], cycles: dict[str, float], clock_ns: float) -> DataFrame:
    """Background and command energy (pJ per 1e-3 of the units given) from counters: active, idle, act, pre, rd, wr, ref.

    A command costs what its current exceeds the standby it interrupts by, for
    as long as it lasts; refresh is counted whole.
    """

    def power(now: str, base: str | None = None) -> float:
        supply = amps[f"IDD{now}"] - (amps[f"IDD{base}"] if base else 0)
        pump = amps[f"IPP{now}"] - (amps[f"IPP{base}"] if base else 0)
        return volts["VDD"] * supply + volts["VPP"] * pump

    def spent(count: str, watts: float, long: float) -> Column:
        return F.col(count) * (watts * long * clock_ns / 1e3)

    background = spent("active", power("3N"), 1) + spent("idle", power("2N"), 1)
    commands = spent("act", power("0", "3N"), cycles["RAS"]) + spent("pre", power("0", "2N"), cycles["RP"]) + spent("rd", power("4R", "3N"), cycles["BL"]) + spent("wr", power("4W", "3N"), cycles["BL"]) + spent("ref", power("5B"), cycles["RFC"])
    return counters.withColumn("background", background).withColumn("commands", commands).withColumn("total", F.col("background") + F.col("commands"))


# Counters with bounded state


def passed(df: DataFrame, key: str, order: list[str], item: str, epoch: Column, start: Callable[[], object], schema: str) -> DataFrame:
    """One pass over each key's rows in order.

    ``start`` makes a key's state: called with (item, epoch), it gives the rows
    that the access brings out; ``rows()`` gives what is left at the end.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(item).cast("long").alias("x"), epoch.cast("long").alias("e"), *order)
    kinds = [pa.int64()] * (len(schema.split(",")))
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        for batch in batches:
            for k, x, e in zip(*(batch.column(c).to_pylist() for c in ("k", "x", "e")), strict=True):
                if k != current or state is None:
                    if state is not None:
                        out += [(current, *r) for r in state.rows()]
                    current, state = k, start()
                out += [(k, *r) for r in state(x, e)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
            out = []
        if state is not None:
            out = [(current, *r) for r in state.rows()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return rows.repartition("k").sortWithinPartitions("k", *order).select("k", "x", "e").mapInArrow(run, schema)


class Spilling:
    """At most ``size`` counters and one for all others.

    An item without a counter takes over one that stands at the common
    counter's value, or raises that; so no item occurs more often than its
    counter says.  A new epoch starts at zero.
    """

    def __init__(self, size: int):
        self.size, self.counts, self.spill, self.epoch = size, {}, 0, None

    def __call__(self, item: int, epoch: int):
        out = []
        if epoch != self.epoch:
            out, self.counts, self.spill, self.epoch = self.rows(), {}, 0, epoch
        if item in self.counts:
            self.counts[item] += 1
        elif len(self.counts) < self.size:
            self.counts[item] = self.spill + 1
        else:
            free = min((i for i, n in self.counts.items() if n == self.spill), default=None)
            if free is None:
                self.spill += 1
            else:
                del self.counts[free]
                self.counts[item] = self.spill + 1
        return out

    def rows(self):
        return [(self.epoch, i, n, self.spill) for i, n in sorted(self.counts.items())]


class Pruned:
    """A counter an item, dropped at an epoch's end unless it has ``rate`` accesses for each epoch of its life; out and over at ``most``."""

    def __init__(self, rate: int, most: int):
        self.rate, self.most, self.counts, self.epoch = rate, most, {}, None

    def __call__(self, item: int, epoch: int):
        for _ in range(epoch - self.epoch if self.epoch is not None else 0):
            if not self.counts:
                break
            self.counts = {i: (n, life + 1) for i, (n, life) in self.counts.items() if n >= life * self.rate}
        self.epoch = epoch
        n, life = self.counts.get(item, (0, 0))
        if n + 1 < self.most:
            self.counts[item] = n + 1, life
            return []
        del self.counts[item]
        return [(epoch, item)]

    def rows(self):
        return []


def spilled(df: DataFrame, key: str, order: list[str], item: str, epoch: Column, size: int) -> DataFrame:
    """k, epoch, item, n and spill: what each key's table holds at the end of every epoch."""
    return passed(df, key, order, item, epoch, lambda: Spilling(size), "k long, epoch long, item long, n long, spill long")


def pruned(df: DataFrame, key: str, order: list[str], item: str, epoch: Column, rate: int, most: int) -> DataFrame:
    """k, epoch, item: the accesses at which a counter that was not pruned reaches ``most``."""
    return passed(df, key, order, item, epoch, lambda: Pruned(rate, most), "k long, epoch long, item long")


def digit_hash(item: Column, seed: int, size: int) -> Column:
    """A counter's place for an item, by 32 bits of a digest."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(item.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long"), F.lit(size))


def listed_by_bloom(df: DataFrame, item: str, epoch: Column, size: int, hashes: int, most: int) -> DataFrame:
    """epoch, item and n of the items that two overlapping counting filters report in an epoch.

    A filter collects for two epochs; the older one answers.  An item's n is
    the least of its counters over this epoch and the one before: never less
    than its accesses.
    """
    hits = df.groupBy(epoch.alias("epoch"), F.col(item).alias("item")).agg(F.count("*").alias("n"))
    spread = hits.select("epoch", "item", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), digit_hash(F.col("item"), s, size).alias("at")) for s in range(hashes)])).alias("h"))
    # All hashes share one array of counters.
    now = spread.groupBy("epoch", F.col("h.at").alias("at")).agg(F.sum("n").alias("n"))
    both = now.unionByName(now.withColumn("epoch", F.col("epoch") + 1)).groupBy("epoch", "at").agg(F.sum("n").alias("c"))
    asked = spread.select("epoch", "item", F.col("h.at").alias("at")).join(both, ["epoch", "at"])
    return asked.groupBy("epoch", "item").agg(F.min("c").alias("n")).where(F.col("n") >= most)


def grouped_then_single(df: DataFrame, key: str, order: list[str], item: str, group: Column, most_group: int, most: int) -> DataFrame:
    """Accesses at which an item's counter reaches a multiple of ``most``.

    A group of items shares a counter up to ``most_group``; from then on each
    of its items has its own, which starts from there.
    """
    w = Window.partitionBy(key, "_g").orderBy(*order)
    rows = df.withColumn("_g", group).withColumn("_in_group", F.row_number().over(w))
    single = rows.where(F.col("_in_group") > most_group)
    own = Window.partitionBy(key, item).orderBy(*order)
    counted = single.withColumn("n", (F.row_number().over(own) + most_group).cast("long"))
    return counted.where(F.col("n") % most == 0).drop("_g", "_in_group")


def sampled(df: DataFrame, row_id: str, share: float, seed: int) -> DataFrame:
    """Rows drawn with a probability, by a hash of the id: the same ones in every run."""
    return df.where(digit_hash(F.col(row_id), seed, 1_000_000) < int(share * 1_000_000))

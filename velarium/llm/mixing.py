"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources, in code-point order with null last, carry the weights
3, 1, 2, repeating, and share 150 % of all words.  No target exceeds twice its
source's words; what a full source leaves is shared again by weight.  That is
``target = min(weight * level, 2 * words)`` for the one level that makes the
targets add up, found in closed form over the source totals.

Sampling: a document of a source is expected target/words times.  The whole
part of that is allocated to all its documents as certain copies.  The words
that the target still needs come from a sample with inclusion probabilities
in proportion to size, capped at 1: pi = min(1, rate * size), with the rate at
which the expected words, sum of pi * size, are those needed.  Documents with
pi = 1 are certain too.  The others are ranked by Pareto's key
[u/(1-u)] / [pi/(1-pi)], u being a hash of the row, and taken in that order up
to the sample's fixed size, which is counted in words.  One more document, the
one whose size comes closest to the gap that is left, closes it where that
brings the source nearer.

No source is ever sorted as a whole: the cut is found by two counting passes
over 4,096 intervals of the key each, and only what lies in one small interval
is ordered, equal rows as one item.  Where the cut falls among equal rows,
they are numbered inside their partitions.  Every result is a function of the
rows, so reruns agree.

Defined cases: null texts have no words; a source without words has target 0;
documents without words take 0; equal rows (id and text, also a null id) are
taken one by one; columns named like the results are replaced, others pass; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, cut, given_back, word_count

#: The corpus contract's weights, in source order, and its share of all words.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Each counting pass resolves BITS bits of the key; rows that one task adds up in order.
BITS, RUN = 12, 65_536
RESULTS = ("size", "source_size", "target", "copies", "taken")


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add, for each ``name: column``, the column's sum over the rows before; ``order`` is total."""
    parts = max(1, -(-df.count() // RUN))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = dealt.select("*", *[before(Window.partitionBy("_part").orderBy(*order), c).alias(f"_in_{n}") for n, c in sums.items()])
    groups = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()])  # one row for RUN rows
    groups = groups.select(F.col("_part").alias("_p"), *[before(Window.orderBy("_part"), f"_of_{n}").alias(f"_to_{n}") for n in sums])
    return inside.join(groups, F.col("_part") == F.col("_p")).select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_to_{n}")).alias(n) for n in sums])


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add weight and target to ``totals`` (source, source_size): one row for each source."""
    by_source = [F.col("source").asc_nulls_last()]
    placed = running(totals.withColumn("one", F.lit(1).cast("long")), by_source, {"place": "one"})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    t = placed.select("source", "source_size", w.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    # Sources in the order in which a rising level fills them; what the earlier ones take at their caps, and their weights.
    t = cut(running(t.withColumn("fills", F.col("cap") / F.col("weight")), [F.col("fills"), *by_source], {"capped": "cap", "closed": "weight"}))
    total, open_ = t.agg(F.sum("source_size") * float(share), F.sum("weight")).first()
    level = (F.lit(total) - F.col("capped")) / (F.lit(open_) - F.col("closed"))
    # The level is that of the first source which it does not fill.
    found = t.where(level * F.col("weight") < F.col("cap")).agg(F.min(F.struct("fills", F.col("source").isNull(), "source", level.alias("level")))["level"]).first()[0]
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.lit(found) * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def measured(documents: DataFrame, seed: int, columns: list[str]) -> DataFrame:
    """Of each document own (the columns), _source, size, row (a number of its own), name (a hash of id and text) and u."""
    name = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed)), F.coalesce(F.col("text"), F.lit(""))))
    rows = documents.select(carried(columns).alias("own"), F.col("source").alias("_source"), word_count(F.col("text")).alias("size"), name.alias("_name"), F.monotonically_increasing_id().alias("_row"))
    # u is the middle of one of 2**52 intervals, so u and 1 - u are exact doubles and neither is 0.
    u = (F.conv(F.substring("_name", 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return rows.withColumn("_u", u).withColumn("_name", F.unhex("_name"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def rates(rows: DataFrame) -> DataFrame:
    """For each source: source_size, target, copies (certain ones of every document), need (words) and rate."""
    sizes = cut(rows.groupBy(F.col("_source").alias("source"), "size").agg(F.count("*").alias("n")))
    t = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("copies", F.floor(ratio).cast("int")).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    t = cut(t.select(F.col("source").alias("_s"), "source_size", "target", "copies", "need"))
    # If all sizes above one are capped, the rate is that which the rest needs; the largest size it does not cap is the one.
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    words, squares = (F.col("size") * F.col("n")).cast("double"), (F.col("size") * F.col("size") * F.col("n")).cast("double")
    h = sizes.where("size > 0").withColumn("above", F.coalesce(F.sum(words).over(larger), F.lit(0.0))).withColumn("above2", F.coalesce(F.sum(squares).over(larger), F.lit(0.0)))
    h = h.withColumn("all2", F.sum(squares).over(Window.partitionBy("source")))
    h = h.join(t, _same("source", "_s")).withColumn("rate", (F.col("need") - F.col("above")) / (F.col("all2") - F.col("above2")))
    h = h.where(F.col("rate") * F.col("size") <= 1).groupBy("source").agg(F.max_by("rate", "size").alias("rate"))
    return t.join(h, _same("_s", "source"), "left").select(*t.columns, F.coalesce("rate", F.lit(0.0)).alias("rate"))


def _key(rate: Column) -> Column:
    """Pareto's key: 0 of certain documents, null of those without a chance."""
    pi = rate * F.col("size")
    return F.when(pi >= 1, F.lit(0.0)).when(pi > 0, F.col("_u") / (1 - F.col("_u")) * ((1 - pi) / pi))


def _bin(key: Column, level: int) -> Column:
    """The key's interval among 2**(BITS * level)."""
    return F.floor(key / (1 + key) * float(1 << BITS * level))


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each source takes beyond its certain copies.

    First, one row a source: its rates, and the last interval with the first
    key and name in it that is not taken.  Second, single items of which only
    some rows are taken: _s, name and how many.
    """
    t = cut(rates(rows))  # read back, its size is known: no shuffle of the rows, if it is small
    chance = lambda at: rows.join(at, _same("_source", "_s")).withColumn("key", _key(F.col("rate"))).where("key is not null")
    certain = chance(t.select("_s", "rate")).where("key = 0").groupBy("_s").agg(F.sum("size").alias("before")).withColumnRenamed("_s", "_b")
    at = cut(t.join(certain, _same("_s", "_b"), "left").select(*t.columns, F.lit(0).cast("long").alias("low"), F.coalesce("before", F.lit(0)).cast("long").alias("before")))
    for level in (1, 2):
        # Words in each interval of the key, of the sources' current intervals only; few rows, summed up source by source.
        inside = chance(at.select("_s", "rate", "low")).where((F.col("key") > 0) & (_bin(F.col("key"), level - 1) == F.col("low")))
        sums = inside.groupBy("_s", _bin(F.col("key"), level).alias("bin")).agg(F.sum("size").alias("words")).withColumnRenamed("_s", "_b")
        w = Window.partitionBy("_b").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(w)).join(at.select("_s", "before", "need"), _same("_b", "_s")).withColumn("upto", F.col("upto") + F.col("before"))
        # The first interval that passes what is needed; if none does, everything is taken and the last one serves.
        begin = F.struct("bin", (F.col("upto") - F.col("words")).alias("b"))
        step = sums.groupBy("_b").agg(F.min(F.when(F.col("upto") > F.col("need"), begin)).alias("hit"), F.max(begin).alias("end"))
        step = step.select("_b", F.coalesce("hit.bin", "end.bin").alias("low2"), F.coalesce("hit.b", "end.b").alias("before2"))
        at = cut(at.join(step, _same("_s", "_b"), "left").select(*t.columns, F.coalesce("low2", F.when(F.lit(level == 1), F.lit(0)).otherwise(F.col("low") * (1 << BITS))).alias("low"), F.coalesce("before2", "before").alias("before")))
    # Equal rows of the last interval are one item.
    last = chance(at.select("_s", "rate", "low")).where((F.col("key") > 0) & (_bin(F.col("key"), 2) == F.col("low")))
    items = last.groupBy("_s", "key", "_name", "size").agg(F.count("*").alias("n")).withColumnRenamed("_s", "_b")
    w = Window.partitionBy("_b").orderBy("key", "_name", "size").rowsBetween(Window.unboundedPreceding, 0)
    items = items.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(w)).join(at.select("_s", "before", "need"), _same("_b", "_s"))
    items = items.withColumn("upto", F.col("upto") + F.col("before")).withColumn("start", F.col("upto") - F.col("size") * F.col("n"))
    split = items.where(F.col("upto") > F.col("need")).groupBy("_b").agg(F.min(F.struct("key", "_name", "size", "start", "need")).alias("x"))
    fit = F.greatest(F.floor((F.col("x.need") - F.col("x.start")) / F.col("x.size")), F.lit(0)).cast("long")
    split = split.select("_b", F.struct("x.key", "x._name").alias("edge"), fit.alias("some"), (F.col("x.start") + fit * F.col("x.size")).alias("got"))
    whole = items.groupBy("_b").agg(F.max("upto").alias("all")).withColumnRenamed("_b", "_w")
    at = at.join(split, _same("_s", "_b"), "left").join(whole, _same("_s", "_w"), "left")
    at = cut(at.select(*t.columns, "low", "edge", F.coalesce("some", F.lit(0)).alias("some"), F.coalesce("got", "all", "before").alias("got")))
    gap = F.col("need") - F.col("got")
    left = chance(at.select("_s", "rate", "low", "edge", "need", "got")).where(~_ahead() & (F.col("size") < 2 * gap))
    # Of the border's item some rows are taken already; one more of them is as good as of any other.
    filler = left.groupBy("_s").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("off"), "key", F.col("_name").alias("name"), "size")).alias("f"))
    border = at.where("edge is not null and some > 0").select("_s", F.col("edge._name").alias("name"), F.col("some").alias("n"))
    spare = filler.select("_s", "f.name", F.lit(1).cast("long").alias("n"))
    single = border.unionByName(spare).groupBy("_s", "name").agg(F.sum("n").alias("n"))
    return at.select("_s", "source_size", "target", "copies", "rate", "low", "edge"), cut(single)


def _ahead() -> Column:
    """Whether a row with a key stands before the border: certain, or in an earlier place of the order."""
    place, low = _bin(F.col("key"), 2), F.col("low")
    earlier = F.col("edge").isNull() | (F.struct("key", "_name") < F.col("edge"))
    return (F.col("key") == 0) | (place < low) | ((place == low) & earlier)


def chosen(rows: DataFrame, single: DataFrame) -> DataFrame:
    """The _row of as many rows of each single item as are taken: equal rows, numbered partition by partition."""
    own = rows.join(single, _same("_source", "_s") & (F.col("_name") == F.col("name"))).select("_s", "name", "n", "_row", F.shiftright("_row", 33).alias("part"))
    counts = own.groupBy("_s", "name", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("_s", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_s").alias("_s2"), F.col("name").alias("_n2"), F.col("part").alias("_p2"), before.alias("before"))
    number = F.row_number().over(Window.partitionBy("_s", "name", "part").orderBy("_row"))
    numbered = own.withColumn("number", number).join(counts, _same("_s", "_s2") & (F.col("name") == F.col("_n2")) & (F.col("part") == F.col("_p2")))
    return numbered.where(F.col("before") + F.col("number") <= F.col("n")).select(F.col("_row").alias("_chosen"))


def mix(documents: DataFrame, seed: int = 11, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all) of every document with size, source_size, target, copies and taken."""
    kept = [c for c in columns or documents.columns if c not in RESULTS]
    rows = cut(measured(documents, seed, kept))
    narrow = rows.select("_source", "size", "_name", "_row", "_u")
    at, single = plan(narrow)
    # Read back, their sizes are known: Spark broadcasts them only if they are small.
    d = rows.join(cut(at), _same("_source", "_s")).join(cut(chosen(narrow, single)), F.col("_row") == F.col("_chosen"), "left")
    d = d.withColumn("key", _key(F.col("rate")))
    more = (F.coalesce(F.col("key").isNotNull() & _ahead(), F.lit(False)) | F.col("_chosen").isNotNull()) & (F.col("copies") < MOST)
    d = d.withColumn("copies", F.col("copies") + more.cast("int"))
    return d.withColumn("taken", F.col("copies") * F.col("size")).select(*given_back(kept, "own"), *RESULTS)


def expanded(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy."""
    copies = mixed.where("copies > 0").select(carried(columns).alias("own"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return copies.select(*given_back(columns, "own"))

"""URL filter: a blocked Bloom filter in front of an exact hash join.  DataFrame functions only.

The listed rules are canonical URL beginnings (host, path, verdict).  A rule
fits its host and every subdomain of it, when the URL's path starts with the
rule's path; the longest rule wins.  A page is probed with each of its host's
endings (no more labels than the longest listed host has) joined to each of
its path's beginnings (of the lengths that occur in the list).  A probe hashes
to one 64-bit block and three bits in it; only probes that the filter passes
reach the hash join with the list, which settles them exactly.  Rows that no
rule fits get the method's verdict, ``allow``: they are not listed.

Pages without a passing probe are settled where they are read; only the others
go through the join and are gathered again, so what is exchanged follows the
hits, not the pages.  The filter is a scalar subquery, one array with 8 bits a
rule, up to ``MOST_BLOCKS`` blocks (32 million rules; a longer list only passes
more probes on to the join).  The list is broadcast up to ``MOST_BROADCAST``
rows and else joined by a shuffle of it and the passing probes.

Defined cases: a null url or one without ``://`` has an empty host and path
and no rule; only A-Z are lower-cased; a host keeps port and user; repeated
rows are judged one by one; among rules of equal length the longer host wins;
columns named like the results are replaced, others pass; an
empty table gives an empty result, and an empty list allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, given_back

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_BLOCKS = 1 << 22
MOST_BROADCAST = 100_000
#: Keys of a block, on average; 8 of 64 bits a key.
KEYS_PER_BLOCK = 8

#: The rules of the corpus contract.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.host", "r.path", "r.verdict")


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def _mask(h: Column) -> Column:
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, by).bitwiseAND(63).cast("int"))
    return bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


def bloom(listed: DataFrame, rules: int) -> tuple[Column, int]:
    """The filter as an array of 64-bit blocks, and their number."""
    blocks = min(MOST_BLOCKS, max(16, 1 << (max(rules, 1) // KEYS_PER_BLOCK).bit_length()))
    h = _hash(F.col("host"), F.col("path"))
    masks = listed.select(_block(h, blocks).alias("b"), _mask(h).alias("m"))
    every = masks.unionByName(listed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("m")))
    merged = every.groupBy("b").agg(F.bit_or("m").alias("m")).agg(F.sort_array(F.collect_list(F.struct("b", "m"))).alias("all"))
    return merged.select(F.transform("all", lambda x: x["m"])).scalar(), blocks


def judge(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``."""
    listed = listed.where("host is not null and path is not null").dropDuplicates(["host", "path"])
    shape = listed.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.count("*").alias("n")).first()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(carried(kept).alias("own"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    no_rule = [*given_back(kept, "own"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")]
    if not shape["n"]:
        return rows.select(*no_rule)
    words, blocks = bloom(listed, shape["n"])
    labels = F.split("host", r"\.")
    endings = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - (shape["labels"] - 1)), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    lengths = F.filter(F.array(*[F.lit(n) for n in shape["lengths"]]), lambda n: F.length("path") >= n)
    probes = F.flatten(F.transform(endings, lambda e: F.transform(lengths, lambda n: F.struct(e.alias("h"), F.col("path").substr(F.lit(1), n).alias("p")))))

    def passes(probe: Column) -> Column:
        h = _hash(probe["h"], probe["p"])
        return F.get("_words", _block(h, blocks)).bitwiseAND(_mask(h)) == _mask(h)

    # Projections collapse, so the filter is evaluated as the subquery that it is and never becomes a column of a row.
    probed = rows.withColumn("_words", words).withColumn("_probes", F.filter(probes, passes)).drop("_words")
    clear = probed.where(F.size("_probes") == 0).select(*no_rule)
    hits = probed.where(F.size("_probes") > 0).withColumn("row", F.monotonically_increasing_id())
    hits = hits.select("own", "host", "path", "row", F.explode("_probes").alias("probe"))
    exact = listed.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    exact = F.broadcast(exact) if shape["n"] <= MOST_BROADCAST else exact
    met = hits.join(exact, (F.col("probe.h") == F.col("_h")) & (F.col("probe.p") == F.col("_p")), "left")
    best = F.max(F.when(F.col("_h").isNotNull(), F.struct((F.length("_h") + F.length("_p")).alias("n"), F.length("_h").alias("m"), F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict"))))
    # A row's probes stay in its task, so partial aggregation leaves one row for each to exchange.
    judged = met.groupBy("row").agg(F.first(F.struct("own", "host", "path")).alias("r"), best.alias("b")).select("r.*", "b")
    return clear.unionByName(judged.select(*given_back(kept, "own"), "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit("allow")).alias("verdict")))

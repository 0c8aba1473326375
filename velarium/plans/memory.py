"""Queries of the memory system: mapping, translation, energy, bounded counters."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import memory

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def addresses(spark: SparkSession, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729).cast("long").alias("addr"))


def events(spark: SparkSession, sf_dir: str):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return e.withColumn("day", F.floor(F.unix_micros("ts") / 86_400_000_000))


ADDRESSES = "SELECT l_orderkey, l_linenumber, (l_partkey * 7919 + l_suppkey * 104729)::BIGINT AS addr FROM lineitem"
EVENTS = "SELECT event_id, ts, user_id, event_type, epoch_us(ts) // 86400000000 AS day FROM events"


def _layout_sql(layout: str) -> str:
    at, fields = 0, []
    for name in memory.LAYOUTS[layout]:
        fields.append(f"(addr // {1 << at}) % {1 << memory.WIDTHS[name]} AS {name}")
        at += memory.WIDTHS[name]
    return f"SELECT l_orderkey, l_linenumber, {', '.join(fields)} FROM ({ADDRESSES})"


def _layout(layout: str):
    @query(_layout_sql(layout))
    def mapped(spark, sf_dir):
        a = addresses(spark, sf_dir)
        return a.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in memory.mapped(F.col("addr"), layout).items()])

    for table in (QUERIES, ORACLES):
        table[f"addr_{layout}"] = table.pop("mapped")


for _name in memory.LAYOUTS:
    _layout(_name)

INTERLEAVED = (
    f"SELECT l_orderkey, l_linenumber, xor(ch, col % 4) AS channel, xor(ra, (col // 4) % 2) AS rank, xor(bg, (col // 8) % 4) AS bankgroup, xor(ba, (col // 32) % 4) AS bank, row_, col FROM "
    f"(SELECT l_orderkey, l_linenumber, addr // 4 % 4 AS ch, addr // 16 % 2 AS ra, addr // 32 % 4 AS bg, addr // 128 % 4 AS ba, addr % 4 + addr // 512 % 16 * 4 AS col, addr // 8192 AS row_ FROM ({ADDRESSES}))"
)


@query(INTERLEAVED)
def addr_interleaved(spark, sf_dir):
    """Runs of four columns over the banks, the banks mixed with column bits."""
    return addresses(spark, sf_dir).select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in memory.mapped_interleaved(F.col("addr")).items()])


@query(f"SELECT l_orderkey, l_linenumber, channel, rank, bankgroup, bank, CASE WHEN row_ % 64 < 2 THEN row_ + 1 - 2 * (row_ % 2) ELSE row_ END AS row_, col FROM ({INTERLEAVED})")
def addr_indirected(spark, sf_dir):
    """Row indirection: in every bank the first two rows of each 64 have changed places."""
    banks = [n for n in memory.FIELDS if n not in ("row_", "col")]
    a = addr_interleaved(spark, sf_dir)
    table = a.where("row_ % 64 < 2").select(*banks, "row_").distinct().withColumn("to", F.col("row_") + 1 - 2 * (F.col("row_") % 2))
    return memory.indirected(a, table, banks).select("l_orderkey", "l_linenumber", *memory.FIELDS)


@query(f"SELECT l_orderkey, l_linenumber, ((addr // 4096 % 65536) * 40503 + 12345) % 65536 * 4096 + addr % 4096 AS physical FROM ({ADDRESSES})")
def addr_translated(spark, sf_dir):
    """Pages placed by a seeded permutation, offsets kept."""
    return addresses(spark, sf_dir).select("l_orderkey", "l_linenumber", memory.translated(F.col("addr"), 12, 16, 40503, 12345).alias("physical"))


#: A part's supply voltages, currents (mA) and command lengths (cycles).
VOLTS = {"VDD": 1.2, "VPP": 2.5}
AMPS = {"IDD0": 60, "IDD2N": 50, "IDD3N": 55, "IDD4R": 145, "IDD4W": 145, "IDD5B": 362, "IPP0": 3, "IPP2N": 3, "IPP3N": 3, "IPP4R": 3, "IPP4W": 3, "IPP5B": 48}
CYCLES = {"RAS": 39, "RP": 16, "BL": 4, "RFC": 313}


@query(
    "SELECT rank, round(background, 6) AS background, round(commands, 6) AS commands, round(background + commands, 6) AS total FROM (SELECT rank, "
    "0.833 / 1e3 * (active * (1.2 * 55 + 2.5 * 3) + idle * (1.2 * 50 + 2.5 * 3))::DOUBLE AS background, "
    "0.833 / 1e3 * (act * 1.2 * 5 * 39 + pre * 1.2 * 10 * 16 + rd * 1.2 * 90 * 4 + wr * 1.2 * 90 * 4 + ref * (1.2 * 362 + 2.5 * 48) * 313)::DOUBLE AS commands FROM "
    "(SELECT l_suppkey % 4 AS rank, sum(l_quantity)::BIGINT AS active, count(*) * 7 AS idle, count(*) AS act, count(*) FILTER (l_linenumber > 1) AS pre, count(*) FILTER (l_returnflag = 'N') AS rd, "
    "count(*) FILTER (l_returnflag <> 'N') AS wr, count(DISTINCT l_shipdate) AS ref FROM lineitem GROUP BY 1))"
)
def memory_energy(spark, sf_dir):
    """Background and command energy of each rank, from its counters."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    counters = line.groupBy((F.col("l_suppkey") % 4).alias("rank")).agg(
        F.sum("l_quantity").cast("long").alias("active"), (F.count("*") * 7).alias("idle"), F.count("*").alias("act"), F.count_if(F.col("l_linenumber") > 1).alias("pre"),
        F.count_if(F.col("l_returnflag") == "N").alias("rd"), F.count_if(F.col("l_returnflag") != "N").alias("wr"), F.countDistinct("l_shipdate").alias("ref"),
    )
    e = memory.energy(counters, VOLTS, AMPS, CYCLES, 0.833)
    return e.select("rank", *[F.round(c, 6).alias(c) for c in ("background", "commands", "total")])


@query(f"SELECT day, user_id, n AS exact, true AS held FROM (SELECT *, sum(n) OVER (PARTITION BY day) AS all_ FROM (SELECT day, user_id, count(*) AS n FROM ({EVENTS}) GROUP BY day, user_id)) WHERE n * 21 > all_")
def spilling_counters(spark, sf_dir):
    """Daily users that 20 counters must hold, with counts that bound theirs from above."""
    e = events(spark, sf_dir).withColumn("one", F.lit(0))
    table = memory.spilled(e, "one", ["ts", "event_id"], "user_id", F.col("day"), 20).select(F.col("epoch").alias("day"), F.col("item").alias("user_id"), "n")
    exact = e.groupBy("day", "user_id").agg(F.count("*").alias("exact"))
    total = exact.groupBy("day").agg(F.sum("exact").alias("all_"))
    heavy = exact.join(total, "day").where(F.col("exact") * 21 > F.col("all_"))
    return heavy.join(table, ["day", "user_id"], "left").select("day", "user_id", "exact", F.coalesce(F.col("n") >= F.col("exact"), F.lit(False)).alias("held"))


@query()
def pruned_counters(spark, sf_dir):
    """Accesses at which a user's counter reaches 6, where counters of less than two events a day were dropped."""
    kinds = events(spark, sf_dir).withColumn("kind", F.crc32("event_type"))
    return memory.pruned(kinds, "kind", ["ts", "event_id"], "user_id", F.col("day"), 2, 6)


def _place(seed: int) -> str:
    return f"('0x' || substr(md5(user_id || ':{seed}'), 1, 8))::BIGINT % 512"


@query(
    f"WITH e AS ({EVENTS}), h AS (SELECT day, user_id, count(*) AS n FROM e GROUP BY day, user_id), s AS (" + " UNION ALL ".join(f"SELECT day, user_id, n, {_place(s)} AS place FROM h" for s in range(3)) + "), "
    "now AS (SELECT day, place, sum(n) AS n FROM s GROUP BY day, place), both_ AS (SELECT day, place, sum(n) AS c FROM (SELECT * FROM now UNION ALL SELECT day + 1, place, n FROM now) GROUP BY day, place) "
    "SELECT day AS epoch, user_id AS item, min(c)::BIGINT AS n FROM s JOIN both_ USING (day, place) GROUP BY day, user_id HAVING min(c) >= 4"
)
def bloom_listed(spark, sf_dir):
    """Users that two overlapping counting Bloom filters report with four events in two days."""
    return memory.listed_by_bloom(events(spark, sf_dir), "user_id", F.col("day"), 512, 3, 4)


@query(
    f"SELECT user_id, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) + 16 AS n FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 32 ORDER BY ts, event_id) AS k FROM ({EVENTS})) WHERE k > 16) WHERE n % 8 = 0"
)
def hybrid_counters(spark, sf_dir):
    """Counters that 32 groups of users share until they stand at 16, and every user's own from then on."""
    found = memory.grouped_then_single(events(spark, sf_dir), "event_type", ["ts", "event_id"], "user_id", F.col("user_id") % 32, 16, 8)
    return found.select("user_id", "event_id", "n")


@query(f"SELECT event_id, user_id FROM ({EVENTS}) WHERE ('0x' || substr(md5(event_id || ':5'), 1, 8))::BIGINT % 1000000 < 20000")
def sampled_triggers(spark, sf_dir):
    """Each event draws a two-in-a-hundred chance of a preventive action."""
    return memory.sampled(events(spark, sf_dir), "event_id", 0.02, 5).select("event_id", "user_id")


# Bits and hashes


@query(
    "SELECT bits, CASE WHEN e = 31 AND m > 0 THEN NULL WHEN e = 31 THEN s * 'inf'::DOUBLE WHEN e = 0 THEN s * m * pow(2.0, -24) ELSE s * (1 + m / 1024.0) * pow(2.0, e - 15) END + 0.0 AS value, "
    "CASE WHEN e = 31 AND m > 0 THEN 32256 ELSE bits END AS again FROM (SELECT range AS bits, range // 1024 % 32 AS e, range % 1024 AS m, CASE WHEN range >= 32768 THEN -1 ELSE 1 END AS s FROM range(0, 65536))"
)
def fp16_bits(spark, sf_dir):
    """All half-precision encodings decoded, and encoded again."""
    bits = spark.range(65536).withColumnRenamed("id", "bits")
    value = numeric.fp16_decode(F.col("bits"))
    return bits.select("bits", F.when(~F.isnan(value), value + 0.0).alias("value"), numeric.fp16_encode(value, F.col("bits") >= 32768).alias("again"))


MIX = "(xor({x}, {x} // {d}::UHUGEINT) * {m}::UHUGEINT) % 18446744073709551616::UHUGEINT"


@query(
    "SELECT vec_id, xor(z, z // 2147483648::UHUGEINT)::UBIGINT::VARCHAR AS mixed FROM (SELECT vec_id, " + MIX.format(x="y", d=1 << 27, m=0x94D049BB133111EB) + " AS z FROM (SELECT vec_id, " + MIX.format(x="x", d=1 << 30, m=0xBF58476D1CE4E5B9)
    + f" AS y FROM (SELECT vec_id, (vec_id::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM embeddings)))"
)
def mixed_ids(spark, sf_dir):
    """A 64-bit mixing of ids, as unsigned decimal text."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    return e.select("vec_id", numeric.split_mix("vec_id").cast("string").alias("mixed"))


@query(
    "SELECT DISTINCT event_type, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(event_type, ''), lambda c: ascii(c)::UHUGEINT)), "
    "lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT::VARCHAR AS digest FROM events"
)
def fnv_digests(spark, sf_dir):
    """64-bit FNV-1a of the event types, as unsigned decimal text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    return e.select("event_type", numeric.fnv1a(F.col("event_type").cast("binary")).cast("string").alias("digest"))

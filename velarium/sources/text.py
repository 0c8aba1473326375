"""Text inputs: typed tables, key-value settings, logs and address traces; metadata files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import positions


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A headed table of declared types: missing columns, bad cells and empty tables are errors."""
    names = spark.read.csv(path, sep=sep, header=True).columns
    df = spark.read.schema(schema).csv(path, sep=sep, header=True, mode="FAILFAST", enforceSchema=False)
    missing = [c for c in df.columns if c not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError(f"{path}: no rows")
    return df


def setting(text: Column, key: str) -> Column:
    """The first ``key: value`` of a settings text, null if there is none."""
    found = F.regexp_extract(text, rf"(?m)^[ \t]*{key}[ \t]*:[ \t]*([^\s#]+)", 1)
    return F.when(found != "", found)


def settings(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """file and one column a key, from whole settings files."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select("file", *[setting(F.col("value"), k).alias(k) for k in keys])


def log_rows(lines: DataFrame) -> DataFrame:
    """Rows ``list-size time qps recall`` of a benchmark log; other lines are passed over."""
    number = r"([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)"
    pattern = rf"^\s*(\d+)\s+{number}\s+{number}\s+{number}\s*$"
    part = lambda i, t: F.regexp_extract("value", pattern, i).cast(t)
    return lines.where(F.col("value").rlike(pattern)).select(part(1, "int").alias("list_size"), part(2, "double").alias("time"), part(3, "double").alias("qps"), part(4, "double").alias("recall"))


def _address(x: Column) -> Column:
    hexadecimal = F.conv(F.regexp_extract(x, r"^0[xX]([0-9a-fA-F]+)$", 1), 16, 10)
    return F.when(x.rlike(r"^0[xX][0-9a-fA-F]+$"), hexadecimal).when(x.rlike(r"^\d+$"), x).otherwise(F.raise_error(F.concat(F.lit("not an address: "), x))).cast("decimal(20,0)").cast("long")


def load_store_trace(lines: DataFrame) -> DataFrame:
    """``LD addr`` and ``ST addr`` lines; anything else is an error."""
    w = F.split(F.trim("value"), r"\s+")
    ok = (F.size(w) == 2) & w[0].isin("LD", "ST")
    kind = F.when(ok, w[0]).otherwise(F.raise_error(F.concat(F.lit("not a trace line: "), F.col("value"))))
    return lines.select(kind.alias("op"), _address(w[1]).alias("addr"))


def read_write_trace(lines: DataFrame) -> DataFrame:
    """``R a,b,c`` and ``W a,b,c`` lines: an operation and an address vector."""
    w = F.split(F.trim("value"), r"\s+")
    ok = (F.size(w) == 2) & w[0].isin("R", "W")
    kind = F.when(ok, w[0]).otherwise(F.raise_error(F.concat(F.lit("not a trace line: "), F.col("value"))))
    return lines.select(kind.alias("op"), F.transform(F.split(w[1], ","), lambda x: x.cast("int")).alias("addr_vec"))


def write_metadata(spark: SparkSession, fields: dict[str, object], path: str) -> None:
    """A field/value table."""
    rows = [(k, str(v)) for k, v in fields.items()]
    spark.createDataFrame(rows, "field string, value string").coalesce(1).write.csv(path, sep="\t", header=True)


def read_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """A bundle's metadata: a bounded number of fields."""
    return {r["field"]: r["value"] for r in spark.read.csv(path, sep="\t", header=True).collect()}


def capped(df: DataFrame, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of a trace for a capped sink, and one row with how many it dropped."""
    return df.orderBy(*order).limit(most), df.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"))


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """line (from 0) and value: ``df`` as a Markdown table, its rows in ``order``, which are numbered in ranges."""
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    plain = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([|\\])", r"\\$1")
    body = positions(df.select(*order, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(df.columns)]), order, [], "_n")
    lines = body.select((F.col("_n") + 2).alias("line"), row([F.regexp_replace(plain(f"_c{i}"), r"\s*\R\s*", " ") for i in range(len(df.columns))]).alias("value"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "| " + " | ".join("---" for _ in df.columns) + " |")], "line long, value string")
    return head.unionByName(lines)


def write_markdown(df: DataFrame, order: list[str], path: str) -> None:
    """The table as text files that follow each other by name."""
    markdown(df, order).repartitionByRange("line").sortWithinPartitions("line").select("value").write.text(path)

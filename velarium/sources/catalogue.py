"""The catalogue of public vector datasets that benchmarks refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, rows, dimension and metric.
DATASETS = [
    ("deep10m", 10_000_000, 96, "l2"),
    ("t2i1m", 1_000_000, 200, "ip"),
    ("wiki1m", 1_000_000, 768, "ip"),
    ("w2v1m", 1_000_000, 300, "angular"),
    ("glove2m", 2_196_017, 300, "angular"),
    ("sift1m", 1_000_000, 128, "l2"),
    ("pubmed", 500_000, 768, "l2"),
    ("deep1b", 1_000_000_000, 96, "l2"),
    ("t2i1b", 1_000_000_000, 200, "ip"),
]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, "name string, rows long, dim int, metric string")

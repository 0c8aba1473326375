"""Every query with an oracle against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from velarium.plans import ALL_ORACLES, ALL_QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return v.item() if hasattr(v, "item") else v


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(value(v) for v in r) for r in df[names].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ALL_ORACLES))
def test_oracle(spark, sf_dir, db, name):
    assert rows(ALL_QUERIES[name](spark, sf_dir).toPandas()) == rows(db.execute(ALL_ORACLES[name]).df())

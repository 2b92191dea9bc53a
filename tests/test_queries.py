"""Every registered query of the engine against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from loomtab import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)) or pd.isna(value):
        return "~"
    if isinstance(value, str):
        return value
    return str(value) if isinstance(value, pd.Timestamp) else f"{float(value):.9g}"


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    ours, theirs = engine.queries()[name](spark, DATA).toPandas(), duck.execute(engine.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql()) - {"model_search"}))
def test_gives_rows(spark, name):
    assert engine.queries()[name](spark, DATA).count() > 0

"""Inputs of the registered queries, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inputs derived from the tables; braces name the table.
INPUTS = {
    # two numbers with signs, zeros, gaps and values beyond the guards
    "pairs": """SELECT event_id AS row_id,
        CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 53 = 0 THEN 2e7 WHEN event_id % 59 = 0 THEN 0e0 WHEN event_id % 61 = 0 THEN 55e0 WHEN event_id % 67 = 0 THEN -55e0 ELSE (value - 250e0) / 40e0 END AS a,
        CASE WHEN event_id % 51 = 0 THEN NULL ELSE (event_id % 13 - 6) / 2e0 END AS b FROM {events}""",
    # a category with gaps, a target and a fold
    "cats": """SELECT event_id AS row_id, CASE WHEN event_id % 40 = 0 THEN NULL ELSE event_type END AS c, CASE WHEN user_id % 3 = 0 THEN event_type WHEN user_id % 11 = 0 THEN NULL ELSE 'view' END AS d,
        value AS y, CAST(event_id % 5 AS INT) AS fold FROM {events}""",
    # observations in space and time
    "obs": """SELECT event_id AS row_id, CASE WHEN event_id % 500 = 7 THEN NULL ELSE user_id * 37 % 1200 / 10e0 - 60e0 END AS latitude, user_id * 53 % 3400 / 10e0 - 170e0 AS longitude,
        CAST(event_id * 7 % 365 + 1 AS INT) AS day_of_year, CAST(event_id % 7 AS INT) AS day_of_week, CAST(event_id % 24 AS INT) AS hour,
        CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 12 + 1 END AS INT) AS month, value AS y FROM {events}""",
    # text with sentinels and numbers as text
    "texts": """SELECT event_id AS row_id, CASE WHEN event_id % 7 = 0 THEN '-' WHEN event_id % 11 = 0 THEN 'Unknown' WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS s,
        CAST(event_id AS STRING) AS plain, CONCAT(CAST(event_id % 90 + 1 AS STRING), ',000') AS grouped, CONCAT(CAST(event_id % 100 AS STRING), ' %') AS percent,
        CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v FROM {events}""",
    # predictions: a group's mean against the truth
    "preds": """SELECT o_orderkey AS row_id, o_totalprice AS y, AVG(o_totalprice) OVER (PARTITION BY o_orderpriority) AS p FROM {orders}""",
    "marks": """SELECT event_id AS row_id, CAST(CASE WHEN value > 60 THEN 1 ELSE 0 END AS INT) AS y, (event_id % 97 + 1) / 100e0 AS p, CAST(CASE WHEN event_id % 97 >= 50 THEN 1 ELSE 0 END AS INT) AS label,
        CAST(event_id % 3 AS INT) AS k, CAST(user_id % 3 AS INT) AS m FROM {events}""",
    # a table in two halves by time
    "halves": """SELECT o_orderkey AS row_id, o_totalprice AS v, o_orderpriority AS g, CAST(CASE WHEN o_orderkey % 10 < 7 THEN 1 ELSE 0 END AS INT) AS train FROM {orders}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input as a DataFrame."""
    sql = INPUTS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def inline(name: str) -> str:
    """An input as a DuckDB subquery."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", INPUTS[name]) + ") t"


def tidy(c: Column) -> Column:
    """A number to compare: six decimals, the logarithm where those would be lost; a small offset keeps exact halves from rounding either way."""
    d = c.cast("double")
    return F.when(F.abs(d) < 1e8, F.round(d + 3e-8, 6) + 0.0).otherwise(F.round(F.ln(F.abs(d)), 6))


def tidy_sql(x: str) -> str:
    return f"CASE WHEN abs(CAST({x} AS DOUBLE)) < 1e8 THEN round(CAST({x} AS DOUBLE) + 3e-8, 6) + 0e0 ELSE round(ln(abs(CAST({x} AS DOUBLE))), 6) END"


def query(name: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over one input."""
    return lambda spark, sf_dir: build(frame(spark, sf_dir, name))

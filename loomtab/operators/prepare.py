"""Imputation, scaling and typing: statistics in one aggregation, applied as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions.numeric import number
from loomtab.functions.other import grouped_number, missing, percentage, plain_number


def _row(df: DataFrame, **columns: Column) -> dict:
    return df.agg(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def mode(df: DataFrame, column: str):
    """The most frequent value, of several the smallest; None if all are missing."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()
    return first[0] if first else None


def impute(train: DataFrame, df: DataFrame, numeric: list[str], categorical: list[str], strategy: str = "mean") -> DataFrame:
    """``df`` with missing values filled from ``train``: numbers by mean or median (0 if there is none), text by its mode after sentinels count as missing (``missing`` if there is none)."""
    pick = {"mean": F.avg, "median": F.median}[strategy]
    fill = _row(train, **{c: pick(number(F.col(c))) for c in numeric}) if numeric else {}
    cleaned = train.select(*[missing(F.col(c)).alias(c) for c in categorical]) if categorical else None
    for c in categorical:
        fill[c] = mode(cleaned, c) or "missing"
    return df.select(
        *[F.coalesce(number(F.col(c)), F.lit(fill[c] or 0.0)).alias(c) if c in numeric else F.coalesce(missing(F.col(c)), F.lit(fill[c])).alias(c) if c in categorical else F.col(c) for c in df.columns]
    )


def scale(train: DataFrame, df: DataFrame, columns: list[str], kind: str = "minmax") -> DataFrame:
    """``df`` with columns scaled by statistics of ``train``: ``minmax`` to 0..1, ``standard`` by mean and population deviation; a constant column becomes 0."""
    low, width = (F.min, lambda c: F.max(c) - F.min(c)) if kind == "minmax" else (F.avg, F.stddev_pop)
    stats = _row(train, **{f"{c}_low": low(number(F.col(c))) for c in columns}, **{f"{c}_width": width(number(F.col(c))) for c in columns})

    def scaled(c: str) -> Column:
        return ((number(F.col(c)) - F.lit(stats[f"{c}_low"])) / F.lit(stats[f"{c}_width"] or 1.0)).alias(c)

    return df.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def infer_types(df: DataFrame, rare: float = 0.1) -> DataFrame:
    """(column, role): ``num`` or ``cat`` for every column but ``id``.

    A text column is a category if its distinct values are under ``rare`` of
    the rows, else a number if every value parses as one, plainly, with comma
    thousands or as a percentage; else a category.
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c.lower() != "id"]
    texts = [c for c, t in df.dtypes if t == "string" and c in columns]
    checks = {}
    for c in texts:
        checks[f"{c}|few"] = F.coalesce(F.count_distinct(c) / F.count(F.lit(1)) < rare, F.lit(True))
        for k, f in enumerate((plain_number, grouped_number, percentage)):
            checks[f"{c}|{k}"] = F.count_if(F.col(c).isNotNull() & f(F.col(c)).isNull()) == 0
    found = _row(df, **checks) if checks else {}
    numbers = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    numbers |= {c for c in texts if not found[f"{c}|few"] and any(found[f"{c}|{k}"] for k in range(3))}
    return spark.createDataFrame([(c, "num" if c in numbers else "cat") for c in columns], "column string, role string")

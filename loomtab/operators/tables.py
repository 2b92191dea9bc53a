"""Joins with fitted look-up tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A look-up table is broadcast only if a count has shown that it has at most so many rows.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, counted first; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def attach(df: DataFrame, table: DataFrame, keys: list[str], null_is_key: bool = False) -> DataFrame:
    """``df`` with the look-up table's other columns, null where a key is unknown; ``null_is_key`` makes a null a key like any other."""
    if not null_is_key:
        return df.join(sized(table), keys, "left")
    renamed = table.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in table.columns])
    on = [df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return df.join(sized(renamed), on, "left").drop(*[f"__{k}" for k in keys])

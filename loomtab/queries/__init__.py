"""Registered queries, each beside the DuckDB SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtab.queries import encode, fold, measure, models, scalar, spatial

Query = Callable[[SparkSession, str], DataFrame]
_FAMILIES = (scalar, encode, measure, fold, spatial, models)


def queries() -> dict[str, Query]:
    return {name: query for family in _FAMILIES for name, (query, _) in family.ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, (_, sql) in family.ENTRIES.items() if sql}

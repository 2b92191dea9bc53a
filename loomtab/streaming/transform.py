"""Fitted catalogs over streams: a stateless projection and joins with static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomtab.plans.catalog import Catalog


def transform(stream: DataFrame, catalog: Catalog) -> DataFrame:
    """A stream with the catalog's features; its encoders' tables are joined as static sides."""
    return catalog.transform(stream)


def start(stream: DataFrame, catalog: Catalog, path: str, checkpoint: str) -> StreamingQuery:
    """A query that appends the transformed stream to Parquet files and stops when all there is has been read."""
    return transform(stream, catalog).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

"""Sources and sinks of feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.operators.folds import shuffled


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its path's ending: csv (with header), json, orc or parquet.  A schema spares a pass over text files."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "json", "orc", "parquet"):
        raise ValueError(f"neither csv, json, orc nor parquet: {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    return getattr(reader, kind)(path)


def columns(spark: SparkSession, path: str) -> list[str]:
    """A table's column names, without reading its rows."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True).columns
    return read(spark, path).columns


def write_predictions(df: DataFrame, path: str, key: str, prediction: str) -> None:
    """A submission: key and prediction as CSV with a header."""
    df.select(key, prediction).write.mode("overwrite").csv(path, header=True)


def append(df: DataFrame, path: str) -> None:
    """Rows added to a results table."""
    df.write.mode("append").parquet(path)


def compatible(catalog: DataFrame, least: int = 50, most: int = 50_000, features: int = 1000, ratio: float = 0.5) -> DataFrame:
    """Entries (id, n_samples, n_features, ...) of a size that a search can take."""
    p, n = F.col("n_features"), F.col("n_samples")
    return catalog.where(n.between(least, most) & (p <= features) & (p / n < ratio))


def unused(catalog: DataFrame, used: DataFrame, k: int, seed: int = 42, key: str = "id") -> DataFrame:
    """k entries not used before, in an order that the seed repeats."""
    return catalog.join(used.select(key), key, "left_anti").orderBy(shuffled(F.col(key), seed), key).limit(k)


def near_unique_text(df: DataFrame, share: float = 0.9) -> list[str]:
    """Text columns that are mostly distinct, which a feature table shouldn't have."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return []
    row = df.agg(*[(F.approx_count_distinct(c, 0.02) / F.greatest(F.count(c), F.lit(1))).alias(c) for c in texts]).first()
    return [c for c in texts if row[c] > share]

"""Feature importance: (feature, value) or (method, fold, feature, value) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtab.functions.numeric import correlation, number

# The methods' default weights.
WEIGHTS = {"tree": 0.4, "correlation": 0.2, "permutation": 0.25, "shap": 0.15}


def _long(values: dict[str, Column], df: DataFrame) -> DataFrame:
    flat = df.agg(*[c.alias(k) for k, c in values.items()])
    return flat.select(F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("value")) for k in values])))


def pearson(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Size of each feature's correlation with the target, all in one pass."""
    return _long({f: F.abs(correlation(number(F.col(f)), number(F.col(y)))) for f in features}, df)


def spearman(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Size of the correlation of ranks, ties sharing their mean rank.

    Ranks are worked out over distinct values with their counts, so a value
    that holds most rows is one row of the window.
    """
    out = None
    for f in features:
        rows = df.select(number(F.col(f)).alias("f"), number(F.col(y)).alias("y")).where("f IS NOT NULL AND y IS NOT NULL")
        one = rows.join(_ranks(rows, "f"), "f").join(_ranks(rows, "y"), "y").agg(F.abs(correlation(F.col("f_rank"), F.col("y_rank"))).alias("value")).select(F.lit(f).alias("feature"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def _ranks(rows: DataFrame, column: str) -> DataFrame:
    counts = rows.groupBy(column).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(column, (before + (F.col("count") + 1) / 2).alias(f"{column}_rank"))


def mutual_information(df: DataFrame, features: list[str], y: str, bins: int = 10) -> DataFrame:
    """Mutual information in nats over equal-width bins of feature and target."""
    out = None
    for f in features:
        rows = df.select(number(F.col(f)).alias("f"), number(F.col(y)).alias("y")).where("f IS NOT NULL AND y IS NOT NULL")
        e = rows.agg(F.min("f").alias("fl"), F.max("f").alias("fh"), F.min("y").alias("yl"), F.max("y").alias("yh")).first()
        at = lambda c, lo, hi: F.lit(0) if lo == hi else F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
        cells = rows.groupBy(at("f", e.fl, e.fh).alias("a"), at("y", e.yl, e.yh).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        over = lambda *k: F.sum("n").over(Window.partitionBy(*k))
        one = cells.select("n", over("a").alias("na"), over("b").alias("nb"), over().alias("nn")).agg(F.sum(F.col("n") / F.col("nn") * F.ln(F.col("n") * F.col("nn") / (F.col("na") * F.col("nb")))).alias("value")).select(F.lit(f).alias("feature"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def over_folds(values: DataFrame) -> DataFrame:
    """(method, feature, value, std): means and deviations over folds."""
    return values.groupBy("method", "feature").agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("std"))


def aggregate(values: DataFrame, weights: dict[str, float] | None = None, normalise: bool = False) -> DataFrame:
    """(feature, value) from (feature, method, value).

    Each method is divided by the median of its positive values, or put through
    softmax if ``normalise``; a feature's methods are averaged with weights
    that add up to one over those it has.
    """
    weights = weights or WEIGHTS
    weight = F.coalesce(*[F.when(F.col("method") == m, w) for m, w in weights.items()], F.lit(0.0))
    within, every = Window.partitionBy("method"), Window.partitionBy()
    if normalise:
        scaled = F.exp(F.col("value") - F.max("value").over(within)) / F.sum(F.exp(F.col("value") - F.col("top"))).over(within)
        values = values.withColumn("top", F.max("value").over(within))
    else:
        middles = values.where("value > 0").groupBy("method").agg(F.median("value").alias("top"))
        values = values.join(F.broadcast(middles), "method", "left")  # a row a method
        scaled = F.col("value") / F.coalesce("top", F.lit(1.0))
    each = values.select("feature", scaled.alias("s"), weight.alias("w"))
    out = each.groupBy("feature").agg(F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum("w")).alias("value"))
    if normalise:
        out = out.select("feature", (F.exp("value") / F.sum(F.exp("value")).over(every)).alias("value"))
    return out


def stability(values: DataFrame, k: int) -> DataFrame:
    """(method, stability): mean overlap of the folds' k best features over all pairs of folds."""
    best = Window.partitionBy("method", "fold").orderBy(F.desc("value"), "feature")
    tops = values.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("method", "fold").agg(F.collect_set("feature").alias("s"))  # k features a fold
    other = tops.select("method", F.col("fold").alias("g"), F.col("s").alias("t"))
    return tops.join(other, "method").where("fold < g").groupBy("method").agg(F.avg(F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t"))).alias("stability"))


def top(values: DataFrame, k: int) -> DataFrame:
    """The k best features; all of them for k = -1."""
    ordered = values.orderBy(F.desc("value"), "feature")
    return ordered if k < 0 else ordered.limit(k)

"""Distribution shift between two groups of rows, and weights that answer it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtab.operators.tables import attach


def _steps(df: DataFrame, value: str, train: str) -> DataFrame:
    """(v, f, g, next): both empirical distribution functions at each distinct value, and the value after it."""
    cells = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(train) == 1).alias("a"), F.count_if(F.col(train) == 0).alias("b"))
    so_far, every = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    return cells.select("v", (F.sum("a").over(so_far) / F.sum("a").over(every)).alias("f"), (F.sum("b").over(so_far) / F.sum("b").over(every)).alias("g"), F.lead("v").over(Window.orderBy("v")).alias("next"), F.sum("a").over(every).alias("n"), F.sum("b").over(every).alias("m"))


def kolmogorov_smirnov(df: DataFrame, value: str, train: str = "train") -> DataFrame:
    """One row: the two-sample statistic and its asymptotic p-value."""
    d = _steps(df, value, train).agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("statistic"), F.max("n").alias("n"), F.max("m").alias("m"))
    root = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("statistic")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda t, k: t + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * root * root))
    return d.select("statistic", F.when(root < 0.2, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0))).alias("p_value"))


def wasserstein(df: DataFrame, value: str, train: str = "train") -> DataFrame:
    """One row: the area between the two distribution functions."""
    return _steps(df, value, train).agg(F.coalesce(F.sum(F.abs(F.col("f") - F.col("g")) * (F.col("next") - F.col("v"))), F.lit(0.0)).alias("distance"))


def distribution(df: DataFrame, value: str, train: str = "train") -> DataFrame:
    """One row a value: its share in either group, 0 where it is missing."""
    cells = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(train) == 1).alias("a"), F.count_if(F.col(train) == 0).alias("b"))
    every = Window.partitionBy()
    return cells.select(value, F.coalesce(F.try_divide(F.col("a"), F.sum("a").over(every)), F.lit(0.0)).alias("train_share"), F.coalesce(F.try_divide(F.col("b"), F.sum("b").over(every)), F.lit(0.0)).alias("test_share"))


def chi_square(df: DataFrame, value: str, train: str = "train") -> DataFrame:
    """One row: the statistic of the groups' contingency table and its degrees of freedom."""
    cells = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(train) == 1).alias("a"), F.count_if(F.col(train) == 0).alias("b"))
    every = Window.partitionBy()
    cells = cells.select("a", "b", F.sum("a").over(every).alias("n"), F.sum("b").over(every).alias("m"))
    row = F.col("a") + F.col("b")
    ea, eb = row * F.col("n") / (F.col("n") + F.col("m")), row * F.col("m") / (F.col("n") + F.col("m"))
    return cells.agg(F.sum((F.col("a") - ea) ** 2 / ea + (F.col("b") - eb) ** 2 / eb).alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof"))


def report(df: DataFrame, columns: list[str], train: str = "train") -> DataFrame:
    """One row a numeric column: both means and deviations, and whether the mean moves by more than a tenth of a deviation."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    long = df.select(train, F.inline(F.array(*parts)))
    side = lambda f, k: f(F.when(F.col(train) == k, F.col("v")))
    stats = long.groupBy("column").agg(side(F.avg, 1).alias("train_mean"), side(F.avg, 0).alias("test_mean"), side(F.stddev_samp, 1).alias("train_std"), side(F.stddev_samp, 0).alias("test_std"))
    return stats.select("*", (F.abs(F.col("train_mean") - F.col("test_mean")) > 0.1 * F.col("train_std")).alias("alert"))


def temporal_weights(train: DataFrame, test: DataFrame, columns: list[str], unseen: float = 0.01) -> DataFrame:
    """``train`` with ``weight``: the product of its calendar values' shares in ``test`` over those in ``train``, mean 1.

    The mean comes from the value counts, so no window goes over all rows.
    """
    out = train
    for c in columns:
        n, m = train.count(), test.count()
        a = train.groupBy(c).agg((F.count(F.lit(1)) / F.lit(max(1, n))).alias("__a"))
        b = test.groupBy(c).agg((F.count(F.lit(1)) / F.lit(max(1, m))).alias("__b"))
        ratio = a.join(b, c, "left").select(c, F.coalesce(F.col("__b") / F.col("__a"), F.lit(unseen)).alias(f"__w_{c}"))
        out = attach(out, ratio, [c])
    weight = math.prod([F.coalesce(F.col(f"__w_{c}"), F.lit(unseen)) for c in columns[1:]], start=F.coalesce(F.col(f"__w_{columns[0]}"), F.lit(unseen)))
    out = out.select(*train.columns, weight.alias("weight"))
    mean = out.agg(F.avg("weight")).first()[0] or 1.0
    return out.withColumn("weight", F.col("weight") / F.lit(mean))


def combined(first: Column, second: Column, share: float = 0.7) -> Column:
    return share * first + (1 - share) * second


def crowding_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``weight``: one over the root of how many rows share its place; counted first, so a crowded place is no hot window."""
    counts = df.groupBy(*columns).agg((1 / F.sqrt(F.count(F.lit(1)))).alias("weight"))
    return attach(df, counts, columns, null_is_key=True)


def boosted(weight: Column, where: Column, factor: float = 2.5, low: float = 0.1, high: float = 15.0) -> Column:
    """Weights raised on some rows and held within bounds."""
    return F.greatest(F.least(F.when(where, weight * factor).otherwise(weight), F.lit(high)), F.lit(low))


def summary(df: DataFrame, weight: str = "weight") -> DataFrame:
    return df.agg(F.avg(weight).alias("mean"), F.stddev_pop(weight).alias("std"), F.min(weight).alias("min"), F.max(weight).alias("max"))

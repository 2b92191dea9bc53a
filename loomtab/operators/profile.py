"""Dataset profiles: all statistics of a table in few passes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions.numeric import correlation, number


def dataset_stats(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row: rows, features by role, features a row, density of numbers."""
    p = len(numeric) + len(categorical)
    present = sum((F.count(c) for c in [*numeric, *categorical]), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.lit(p).alias("n_features"), F.lit(len(numeric)).alias("n_numeric"), F.lit(len(categorical)).alias("n_categorical"), (p / F.count(F.lit(1))).alias("feature_ratio"), (present / (F.count(F.lit(1)) * p)).alias("density"))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: missing cells, their share, columns that have any."""
    gaps = [F.count_if(F.col(c).isNull()) for c in columns]
    total = sum(gaps[1:], gaps[0])
    return df.agg(total.alias("missing"), (total / (F.count(F.lit(1)) * len(columns))).alias("ratio"), sum([F.when(g > 0, 1).otherwise(0) for g in gaps[1:]], F.when(gaps[0] > 0, 1).otherwise(0)).alias("columns"))


def _quartiles(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Exact quartiles in one pass; the row that comes back has two numbers a column."""
    row = df.agg(*[F.percentile(number(F.col(c)), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns]).first()
    return {c: tuple(row[c]) if row[c] else (math.nan, math.nan) for c in columns}


def outlier_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of cells beyond one and a half interquartile ranges."""
    bounds = _quartiles(df, columns)
    out = [F.count_if((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))) for c, (q1, q3) in bounds.items()]
    return df.agg((sum(out[1:], out[0]) / (F.count(F.lit(1)) * len(columns))).alias("outlier_ratio"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a pair: (a, b, r), Pearson over rows where both are present, all pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = df.agg(*[correlation(number(F.col(a)), number(F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    return both.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])))


def correlation_summary(df: DataFrame, columns: list[str], high: float = 0.8) -> DataFrame:
    """One row: mean size of the non-zero correlations, and the share of pairs over ``high``."""
    r = correlations(df, columns)
    return r.agg(F.avg(F.when(F.col("r") != 0, F.abs("r"))).alias("mean_correlation"), (F.count_if(F.abs("r") > high) / F.count(F.lit(1))).alias("high_ratio"))


def skewness(c: Column) -> Column:
    """Sample skewness, corrected for bias."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: Column) -> Column:
    """Sample excess kurtosis, corrected for bias."""
    n = F.count(c)
    return F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def _mean(values: list[Column]) -> Column:
    return F.aggregate(F.filter(F.array(*values), lambda x: x.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a.s + x).alias("s"), (a.n + 1).alias("n")), lambda a: F.try_divide(a.s, a.n))


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean size of skewness and of kurtosis over columns."""
    cs = [number(F.col(c)) for c in columns]
    flat = df.agg(*[F.abs(skewness(c)).alias(f"s{i}") for i, c in enumerate(cs)], *[F.abs(kurtosis(c)).alias(f"k{i}") for i, c in enumerate(cs)])
    return flat.select(_mean([F.col(f"s{i}") for i in range(len(cs))]).alias("skewness"), _mean([F.col(f"k{i}") for i in range(len(cs))]).alias("kurtosis"))


def median_deviation(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean distance from the median, averaged over columns."""
    medians = df.agg(*[F.median(number(F.col(c))).alias(c) for c in columns]).first()
    flat = df.agg(*[F.avg(F.abs(number(F.col(c)) - F.lit(medians[c]))).alias(c) for c in columns])
    return flat.select(_mean([F.col(c) for c in columns]).alias("mad"))


def binned_entropy(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """One row: entropy in bits over equal-width bins, averaged over columns; the last bin is closed."""
    ends = df.agg(*[f(number(F.col(c))).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), _bin(number(F.col(c)), ends[f"{c}_lo"], ends[f"{c}_hi"], bins).alias("b")) for c in columns]))).where("b IS NOT NULL")
    counts = long.groupBy("c", "b").count()
    totals = counts.groupBy("c").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log2("count")).alias("s"))
    return totals.agg(F.avg(F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def _bin(c: Column, low: float | None, high: float | None, bins: int) -> Column:
    if low is None or low == high:
        return F.when(c.isNotNull(), 0)
    # least() passes nulls over
    return F.when(c.isNotNull(), F.least(F.floor((c - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int"))


def categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: distinct values, entropy in bits, the most frequent one's count and share."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]))).where("v IS NOT NULL")
    counts = long.groupBy("column", "v").count()
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("cardinality"), (F.log2(F.sum("count")) - F.sum(F.col("count") * F.log2("count")) / F.sum("count")).alias("entropy"), F.max("count").alias("mode_count"), (F.max("count") / F.sum("count")).alias("mode_share")
    )


def target_classes(df: DataFrame, y: str) -> DataFrame:
    """One row: classes, sample deviation of their shares, greatest and least share, greatest over least."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).count()
    total = counts.agg(F.sum("count")).first()[0] or 1
    share = F.col("count") / F.lit(total)
    return counts.agg(F.count(F.lit(1)).alias("n_classes"), F.stddev_samp(share).alias("share_std"), F.max(share).alias("majority"), F.min(share).alias("minority"), F.try_divide(F.max("count"), F.min("count")).alias("balance"))


def target_numbers(df: DataFrame, y: str) -> DataFrame:
    """One row: mean, sample deviation, ends and sample skewness."""
    c = number(F.col(y))
    return df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), skewness(c).alias("skewness"))


def sparsity(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of cells that are zero."""
    zeros = [F.count_if(number(F.col(c)) == 0) for c in columns]
    return df.agg((sum(zeros[1:], zeros[0]) / (F.count(F.lit(1)) * len(columns))).alias("sparsity"))


def complexity(n: Column, p: Column, cat_ratio: Column, missing_ratio: Column, high_correlation: Column, sparse: Column, information: Column, skew: Column | None = None, balance: Column | None = None, classes: Column | None = None) -> Column:
    """A dataset's difficulty from 1 to 10, from its profile."""
    clip = lambda c, lo, hi: F.greatest(F.least(c, F.lit(hi)), F.lit(lo))
    score = 5 + clip(F.log10(F.greatest(n, F.lit(100)) / 1e4), -2.0, 2.0) + clip(F.log10(F.greatest(p, F.lit(10)) / 50), -2.0, 2.0)
    if balance is not None:
        score = score + F.least(F.lit(2.5), 0.6 * F.log2(balance)) + F.least(F.lit(2.0), 0.25 * (classes - 2))
    else:
        score = score + F.when(skew > 1, F.least(F.lit(1.5), 0.7 * F.ln(1 + (skew - 1)))).otherwise(0.0)
    score = score + 1.5 * cat_ratio + 2 * missing_ratio + 2 * high_correlation + 0.5 * sparse + (1 - information)
    return clip(score, 1.0, 10.0)


def infer_task(df: DataFrame, y: str, most_classes: int = 25) -> str:
    """``clf`` or ``reg``: text and integers of few values are classes, other numbers are not."""
    kind = dict(df.dtypes)[y]
    if kind in ("string", "boolean"):
        return "clf"
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return "clf" if whole and df.agg(F.count_distinct(y)).first()[0] <= most_classes else "reg"

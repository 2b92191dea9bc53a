"""Fold generators.

A splitter gives either a fold number for every row (``fold``, for partitions)
or, where folds overlap or leave rows out, the relation (fold, row_id, role)
with role ``train`` or ``val``.  Shuffles are by MD5 of seed and key, which any
engine can repeat; numbers within a group come from a window over the group,
and over a whole table from bounds on the hash or a sort of distinct values, so
no window holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtab.operators.tables import attach, sized

BUCKETS = 1_000_003


def shuffled(key: Column, seed: int = 42) -> Column:
    """A repeatable pseudo-random text for a key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def kfold(df: DataFrame, k: int = 5, key: str = "row_id", seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: the hash's first 28 bits modulo k; folds are even up to chance, without any shuffle."""
    return df.withColumn("fold", (F.conv(F.substring(shuffled(F.col(key), seed), 1, 7), 16, 10).cast("bigint") % k).cast("int"))


def stratified(df: DataFrame, label: str, k: int = 5, key: str = "row_id", seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: each label's rows dealt in turn in hashed order, so folds differ by one row a label."""
    order = Window.partitionBy(label).orderBy(shuffled(F.col(key), seed), key)
    return df.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def quantile_bins(df: DataFrame, y: str, bins: int = 10) -> DataFrame:
    """``df`` with ``bin``: between exact quantiles, ties in one bin; equal widths where quantiles coincide."""
    cut = [i / bins for i in range(1, bins)]
    row = df.agg(F.percentile(y, F.array(*map(F.lit, cut))).alias("q"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    edges = list(row.q or [])
    if len(set(edges)) < len(edges):
        edges = [row.lo + (row.hi - row.lo) * c for c in cut]
    at = sum((F.when(F.col(y) >= e, 1).otherwise(0) for e in edges[1:]), F.when(F.col(y) >= edges[0], 1).otherwise(0)) if edges else F.lit(0)
    return df.withColumn("bin", at)


def stratified_regression(df: DataFrame, y: str, k: int = 5, bins: int = 10, key: str = "row_id", seed: int = 42) -> DataFrame:
    """``df`` with ``fold``, even over quantile bins of a number."""
    return stratified(quantile_bins(df, y, bins), "bin", k, key, seed).drop("bin")


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``, its rows' numbers in order.

    Rows are counted by the first order column's value; only rows of one value
    are numbered together.
    """
    first, rest = order[0], order[1:]
    counts = df.groupBy(first).agg(F.count(F.lit(1)).alias("__n"))
    ahead = counts.select(first, F.coalesce(F.sum("__n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    return attach(df, ahead, [first], null_is_key=True).select(*df.columns, (F.col("__ahead") + F.row_number().over(Window.partitionBy(first).orderBy(*rest)) - 1).alias("place"))


def fixed_window(df: DataFrame, order: list[str], splits: int, test: int, least_train: int, gap: int = 0, key: str = "row_id") -> DataFrame:
    """(fold, row_id, role): expanding training rows before test windows of fixed size, evenly spaced in order."""
    n = df.count()
    room = n - least_train - gap - test
    if room < 0:
        raise ValueError("too few rows for one window")
    starts = [least_train + gap + (int(i * room / (splits - 1)) if splits > 1 else room) for i in range(splits)]
    placed = _numbered(df, order).select(F.col(key).alias("row_id"), "place")
    val = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + test)
    role = F.when(val, "val").when(F.col("place") < F.col("start") - gap, "train")
    both = placed.select("row_id", "place", F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(s).alias("start")) for i, s in enumerate(starts)])).alias("w")).select("row_id", "place", "w.*")
    return both.select("fold", "row_id", role.alias("role")).where("role IS NOT NULL")


def temporal(df: DataFrame, order: list[str], share: float = 0.8, key: str = "row_id") -> DataFrame:
    """(row_id, role): the first rows in order train, the rest validate."""
    cut = int(df.count() * share)
    return _numbered(df, order).select(F.col(key).alias("row_id"), F.when(F.col("place") < cut, "train").otherwise("val").alias("role"))


def masks(df: DataFrame, conditions: list[tuple[Column, int]], key: str = "row_id") -> DataFrame:
    """(fold, row_id, role): a fold for each (condition, least rows) that enough rows meet, the others training."""
    counts = df.agg(*[F.count_if(c).alias(f"n{i}") for i, (c, _) in enumerate(conditions)]).first()
    kept = [c for i, (c, least) in enumerate(conditions) if counts[i] > least]
    if not kept:
        return df.select(F.lit(0).alias("fold"), F.col(key).alias("row_id"), F.lit("val").alias("role")).where("false")
    roles = F.array(*[F.struct(F.lit(i).alias("fold"), F.when(c, "val").otherwise("train").alias("role")) for i, c in enumerate(kept)])
    return df.select(F.col(key).alias("row_id"), F.inline(roles)).select("fold", "row_id", "role")


def month_priority(df: DataFrame, month: str = "month", key: str = "row_id") -> DataFrame:
    """Folds of January, of winter, and of the months nearest to it, each with over 50 rows."""
    m = F.col(month)
    return masks(df, [(m == 1, 0), (m.isin(12, 1, 2), 50), *[(m == k, 50) for k in (2, 12, 3, 11, 10)]], key)


def hybrid(df: DataFrame, key: str = "row_id", month: str = "month", hour: str = "hour", weekday: str = "day_of_week") -> DataFrame:
    """Folds of January and winter, of noon, of Fridays, and of their meeting."""
    m, h, d = F.col(month), F.col(hour), F.col(weekday)
    return masks(df, [(m == 1, 50), (m.isin(12, 1, 2), 100), (h == 12, 30), (d == 4, 50), ((m == 1) & (h == 12) & (d == 4), 10), ((m == 1) & h.isin(11, 12, 15), 20)], key)


def day_buffer(df: DataFrame, val: Column, days: int, day: str = "day_of_year", key: str = "row_id", year: int = 365) -> DataFrame:
    """(row_id, role): rows that ``val`` picks validate; others within ``days`` of one of their days, around the year's end too, are left out."""
    near = df.where(val).select(day).distinct().select(F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("o"), day).select((F.pmod(F.col(day) - 1 + F.col("o"), F.lit(year)) + 1).alias(day)).distinct()
    rest = df.where(~F.coalesce(val, F.lit(False))).join(sized(near), day, "left_anti")
    return df.where(val).select(F.col(key).alias("row_id"), F.lit("val").alias("role")).unionByName(rest.select(F.col(key).alias("row_id"), F.lit("train").alias("role")))


def spatial_buffer(df: DataFrame, val: Column, radius: float, x: str = "latitude", y: str = "longitude", key: str = "row_id") -> DataFrame:
    """(row_id, role): rows that ``val`` picks validate; others within ``radius`` of one of their places are left out.

    Places are distinct points in a grid as wide as the radius; a row looks
    into its own and the eight cells around, in a semi-join.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    places = df.where(val).select(F.col(x).alias("__x"), F.col(y).alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL").distinct()
    places = places.select("*", F.floor(F.col("__x") / radius).alias("__i"), F.floor(F.col("__y") / radius).alias("__j"))
    offsets = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = places.select("__x", "__y", "__i", "__j", F.explode(offsets).alias("o")).select("__x", "__y", (F.col("__i") + F.col("o.a")).alias("__i"), (F.col("__j") + F.col("o.b")).alias("__j"))
    others = df.where(~F.coalesce(val, F.lit(False))).select("*", cell(x).alias("__p"), cell(y).alias("__q"))
    close = (F.col("__p") == F.col("__i")) & (F.col("__q") == F.col("__j")) & (F.hypot(F.col(x) - F.col("__x"), F.col(y) - F.col("__y")) <= radius)
    rest = others.join(sized(spread), close, "left_anti")
    return df.where(val).select(F.col(key).alias("row_id"), F.lit("val").alias("role")).unionByName(rest.select(F.col(key).alias("row_id"), F.lit("train").alias("role")))


def leave_clusters_out(df: DataFrame, cluster: str, clusters: int, k: int = 5, last_takes_rest: bool = False) -> DataFrame:
    """``df`` with ``fold``: runs of ``clusters // k`` cluster numbers a fold; clusters left over are never validated (-1), or go to the last fold."""
    fold = F.floor(F.col(cluster) / max(1, clusters // k)).cast("int")
    return df.withColumn("fold", F.when(fold < k, fold).otherwise(k - 1 if last_takes_rest else -1))


def score_buckets(df: DataFrame, score: str, k: int = 5, buckets: int = 10, key: str = "row_id", seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: even over ``buckets`` of rows from the best score down."""
    n = df.count()
    ordered = _numbered(df.withColumn("__down", -F.col(score)), ["__down", key])
    bucketed = ordered.withColumn("__b", F.least((F.col("place") / max(1, n // buckets)).cast("int"), F.lit(buckets - 1)))
    return stratified(bucketed, "__b", k, key, seed).drop("__b", "__down", "place")


def groups(df: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: whole groups of equal columns, dealt in turn in hashed order."""
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    seen = df.select(*columns).distinct().select(*columns, shuffled(text, seed).alias("__h"))
    dealt = seen.select(*columns, ((F.row_number().over(Window.orderBy("__h")) - 1) % k).cast("int").alias("fold"))
    return attach(df.drop("fold"), dealt, columns, null_is_key=True)


def bands(df: DataFrame, column: str, k: int = 5, key: str = "row_id") -> DataFrame:
    """``df`` with ``fold``: contiguous runs of rows in order of a column."""
    n = max(1, df.count())
    return _numbered(df, [column, key]).withColumn("fold", F.least((F.col("place") * k / n).cast("int"), F.lit(k - 1))).drop("place")


def roles(df: DataFrame, k: int, fold: str = "fold", key: str = "row_id") -> DataFrame:
    """The relation (fold, row_id, role) of a partition into k folds."""
    every = F.sequence(F.lit(0), F.lit(k - 1))
    return df.select(F.col(key).alias("row_id"), F.col(fold).alias("__own"), F.explode(every).alias("fold")).select("fold", "row_id", F.when(F.col("__own") == F.col("fold"), "val").otherwise("train").alias("role"))


def diagnose(relation: DataFrame, df: DataFrame, y: str, month: str | None = None, key: str = "row_id") -> DataFrame:
    """A row a fold: sizes, target means and their difference, January's share in validation."""
    joined = relation.join(df.withColumnRenamed(key, "row_id"), "row_id")
    side = lambda f, r, c: f(F.when(F.col("role") == r, c))
    out = joined.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "val").alias("n_val"), side(F.avg, "train", F.col(y)).alias("train_mean"), side(F.avg, "val", F.col(y)).alias("val_mean"),
        *([F.avg(F.when(F.col("role") == "val", (F.col(month) == 1).cast("double"))).alias("val_january")] if month else []),
    )
    return out.withColumn("difference", F.abs(F.col("train_mean") - F.col("val_mean")))

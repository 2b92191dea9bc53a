"""Fold generators, a query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.operators import folds
from loomtab.queries.base import inline, query, tidy, tidy_sql

_OBS, _CATS, _HALVES = inline("obs"), inline("cats"), inline("halves")
_HASH = "md5('42:' || CAST({k} AS VARCHAR))"
_KFOLD = f"CAST(CAST('0x' || {_HASH.format(k='row_id')}[1:7] AS BIGINT) % 5 AS INT)"


def _dealt(by: str, k: int = 5) -> str:
    return f"CAST((row_number() OVER (PARTITION BY {by} ORDER BY {_HASH.format(k='row_id')}, row_id) - 1) % {k} AS INT)"


def _masks(conditions: list[tuple[str, int]]) -> str:
    parts = " UNION ALL ".join(f"SELECT {i} AS i, row_id, coalesce({c}, false) AS v, (SELECT count_if({c}) FROM {_OBS}) > {least} AS ok FROM {_OBS}" for i, (c, least) in enumerate(conditions))
    return f"SELECT CAST(dense_rank() OVER (ORDER BY i) - 1 AS INT) AS fold, row_id, CASE WHEN v THEN 'val' ELSE 'train' END AS role FROM ({parts}) WHERE ok"


def _fold(source: str, build, sql: str):
    return query(source, lambda df: build(df).select("row_id", "fold")), sql


def _window(df):
    return folds.fixed_window(df, ["day_of_year", "hour", "row_id"], 4, df.count() // 10, df.count() // 2, 7)


_BINNED = f"SELECT row_id, y, (SELECT count(*) FROM unnest(q) t(e) WHERE y >= e) AS bin FROM {_OBS}, (SELECT [" + ", ".join(f"quantile_cont(y, {i / 10})" for i in range(1, 10)) + f"] AS q FROM {_OBS})"

ENTRIES = {
    "fold_kfold": _fold("obs", folds.kfold, f"SELECT row_id, {_KFOLD} AS fold FROM {_OBS}"),
    "fold_stratified": _fold("cats", lambda df: folds.stratified(df, "c"), f"SELECT row_id, {_dealt('c')} AS fold FROM {_CATS}"),
    "fold_stratified_reg": _fold("obs", lambda df: folds.stratified_regression(df, "y"), f"SELECT row_id, {_dealt('bin')} AS fold FROM ({_BINNED})"),
    "fold_quantile_bins": (query("obs", lambda df: folds.quantile_bins(df, "y").select("row_id", "bin")), f"SELECT row_id, CAST(bin AS INT) AS bin FROM ({_BINNED})"),
    "fold_fixed_window": (
        query("obs", _window),
        f"""WITH x AS (SELECT row_id, row_number() OVER (ORDER BY day_of_year, hour, row_id) - 1 AS p, count(*) OVER () AS n FROM {_OBS}), s AS (SELECT *, f, n // 2 + 7 + floor(f * (n - n // 2 - 7 - n // 10) / 3) AS s FROM x, range(4) t(f))
        SELECT CAST(f AS INT) AS fold, row_id, CASE WHEN p >= s AND p < s + n // 10 THEN 'val' ELSE 'train' END AS role FROM s WHERE (p >= s AND p < s + n // 10) OR p < s - 7""",
    ),
    "fold_temporal_split": (
        query("obs", lambda df: folds.temporal(df, ["day_of_year", "hour", "row_id"])),
        f"SELECT row_id, CASE WHEN row_number() OVER (ORDER BY day_of_year, hour, row_id) - 1 < floor((count(*) OVER ()) * 0.8e0) THEN 'train' ELSE 'val' END AS role FROM {_OBS}",
    ),
    "fold_month_priority": (query("obs", folds.month_priority), _masks([("month = 1", 0), ("month IN (12, 1, 2)", 50), *[(f"month = {k}", 50) for k in (2, 12, 3, 11, 10)]])),
    "fold_hybrid_masks": (
        query("obs", folds.hybrid),
        _masks([("month = 1", 50), ("month IN (12, 1, 2)", 100), ("hour = 12", 30), ("day_of_week = 4", 50), ("month = 1 AND hour = 12 AND day_of_week = 4", 10), ("month = 1 AND hour IN (11, 12, 15)", 20)]),
    ),
    "fold_day_buffer": (
        query("obs", lambda df: folds.day_buffer(df, F.col("day_of_year").between(1, 10), 30)),
        f"SELECT row_id, CASE WHEN day_of_year BETWEEN 1 AND 10 THEN 'val' ELSE 'train' END AS role FROM {_OBS} WHERE day_of_year BETWEEN 1 AND 10 OR (day_of_year > 40 AND day_of_year < 336)",
    ),
    "fold_spatial_buffer": (
        query("obs", lambda df: folds.spatial_buffer(df, F.col("row_id") % 100 == 3, 5.0)),
        f"""WITH x AS (SELECT * FROM {_OBS}), v AS (SELECT DISTINCT latitude AS a, longitude AS b FROM x WHERE row_id % 100 = 3 AND latitude IS NOT NULL)
        SELECT row_id, 'val' AS role FROM x WHERE row_id % 100 = 3 UNION ALL SELECT row_id, 'train' FROM x WHERE row_id % 100 <> 3 AND NOT EXISTS (SELECT 1 FROM v WHERE sqrt((latitude - a) * (latitude - a) + (longitude - b) * (longitude - b)) <= 5)""",
    ),
    "fold_leave_cluster_out": _fold("obs", lambda df: folds.leave_clusters_out(df.withColumn("c", F.col("day_of_year") % 12), "c", 12), f"SELECT row_id, CAST(CASE WHEN day_of_year % 12 // 2 < 5 THEN day_of_year % 12 // 2 ELSE -1 END AS INT) AS fold FROM {_OBS}"),
    "fold_score_buckets": _fold(
        "obs", lambda df: folds.score_buckets(df, "y"), f"SELECT row_id, {_dealt('b')} AS fold FROM (SELECT row_id, least((row_number() OVER (ORDER BY -y, row_id) - 1) // (count(*) OVER () // 10), 9) AS b FROM {_OBS})"
    ),
    "fold_groups": _fold(
        "cats", lambda df: folds.groups(df, ["c", "d"]),
        f"WITH g AS (SELECT c, d, CAST((row_number() OVER (ORDER BY md5('42:' || coalesce(c, '') || ',' || coalesce(d, ''))) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT c, d FROM {_CATS})) SELECT x.row_id, g.fold FROM {_CATS.replace(') t', ') x')} JOIN g ON x.c IS NOT DISTINCT FROM g.c AND x.d IS NOT DISTINCT FROM g.d",
    ),
    "fold_bands": _fold("obs", lambda df: folds.bands(df, "latitude"), f"SELECT row_id, CAST(least((row_number() OVER (ORDER BY latitude NULLS FIRST, row_id) - 1) * 5 // (count(*) OVER ()), 4) AS INT) AS fold FROM {_OBS}"),
    "fold_diagnostics": (
        query("obs", lambda df: folds.diagnose(folds.roles(folds.kfold(df), 5), df, "y", "month").select("fold", "n_train", "n_val", *[tidy(F.col(c)).alias(c) for c in ("train_mean", "val_mean", "val_january", "difference")])),
        f"""WITH x AS (SELECT *, {_KFOLD} AS f FROM {_OBS}), g AS (SELECT CAST(k AS INT) AS fold, CAST(count_if(f <> k) AS BIGINT) AS n_train, CAST(count_if(f = k) AS BIGINT) AS n_val, avg(y) FILTER (f <> k) AS t, avg(y) FILTER (f = k) AS v, avg(CASE WHEN month = 1 THEN 1 ELSE 0 END) FILTER (f = k) AS j FROM x, range(5) r(k) GROUP BY k)
        SELECT fold, n_train, n_val, {tidy_sql("t")} AS train_mean, {tidy_sql("v")} AS val_mean, {tidy_sql("j")} AS val_january, {tidy_sql("abs(t - v)")} AS difference FROM g""",
    ),
}

"""Metrics, profiles, shift tests and weights, a query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.operators import importance, metrics, profile, shift
from loomtab.queries.base import frame, inline, query, tidy, tidy_sql

_MARKS, _PREDS, _PAIRS, _CATS, _HALVES, _OBS = (inline(x) for x in ("marks", "preds", "pairs", "cats", "halves", "obs"))


def _row(source: str, build, columns: dict[str, str], where: str = ""):
    """A query over one input whose columns are all numbers to compare."""
    made = lambda df: (r := build(df)).select(*[tidy(F.col(c)).alias(c) for c in columns])
    return query(source, made), "SELECT " + ", ".join(f"{tidy_sql(s)} AS {c}" for c, s in columns.items()) + f" FROM {inline(source)} {where}"


def _agg(source: str, column, sql: str):
    return _row(source, lambda df: df.agg(column(F.col("y"), F.col("p" if source == "preds" else "label")).alias("v")), {"v": sql})


_COUNTS = {"tp": "count_if({y} AND {l})", "fn": "count_if({y} AND NOT {l})", "fp": "count_if(NOT {y} AND {l})", "tn": "count_if(NOT {y} AND NOT {l})"}


def _scores(y: str, label: str) -> dict[str, str]:
    c = {k: v.format(y=f"({y})", l=f"({label})") for k, v in _COUNTS.items()}
    p, r = f"({c['tp']} / ({c['tp']} + {c['fp']} + 1e-8))", f"({c['tp']} / ({c['tp']} + {c['fn']} + 1e-8))"
    return {"accuracy": f"(({c['tp']} + {c['tn']}) / (count(*) + 1e-8))", "precision": p, "recall": r, "f1": f"(2 * {p} * {r} / ({p} + {r} + 1e-8))"}


_BINARY = _scores("y = 1", "label = 1")
_MULTI = {m: "(" + " + ".join(_scores(f"k = {k}", f"m = {k}")[m] for k in range(3)) + ") / 3" for m in _BINARY}
_CLIP = "greatest(least({p}, 1 - 1e-8), 1e-8)"


def _metric(name: str):
    return _row("marks", lambda df: df.agg(metrics.classification(F.col("y"), F.col("label"))[name].alias("v"), metrics.classification(F.col("k"), F.col("m"), [0, 1, 2])[name].alias("macro")), {"v": _BINARY[name], "macro": _MULTI[name]})


_MULTI_P = {0: "p / 2", 1: "(1 - p) / 2", 2: "0.5e0"}
_BINS = "CASE WHEN hi = lo THEN 0 ELSE least(floor(({c} - lo) / ((hi - lo) / 10)), 9) END"
_ENTROPY = "(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {b}))"
_CDF = f"""WITH c AS (SELECT v, count_if(train = 1) AS a, count_if(train = 0) AS b FROM {_HALVES} GROUP BY v), s AS (SELECT v, sum(a) OVER w / sum(a) OVER () AS f, sum(b) OVER w / sum(b) OVER () AS g, lead(v) OVER (ORDER BY v) AS nx, sum(a) OVER () AS n, sum(b) OVER () AS m
    FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"""
_COMPLEX = {"n": "count(*)", "p": "3"}


def _complexity(df):
    r = df.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("c").isNull()) / F.count(F.lit(1))).alias("m"), profile.skewness(F.col("y")).alias("s"))
    return r.select(tidy(profile.complexity(F.col("n"), F.lit(3), F.lit(0.5), F.col("m"), F.lit(0.1), F.lit(0.2), F.lit(0.4), skew=F.abs("s"))).alias("v"))


def _temporal(spark, sf_dir):
    df = frame(spark, sf_dir, "obs")
    return shift.temporal_weights(df.where("row_id % 4 <> 0"), df.where("row_id % 4 = 0 AND month IN (1, 2)"), ["month", "hour"]).select("row_id", tidy(F.col("weight")).alias("weight"))


ENTRIES = {
    "metric_confusion": _row("marks", lambda df: df.agg(*[c.alias(k) for k, c in metrics.confusion(F.col("y"), F.col("label")).items()]), {k: v.format(y="y = 1", l="label = 1") for k, v in _COUNTS.items()}),
    **{f"metric_{m}": _metric(m) for m in _BINARY},
    "metric_log_loss": _row("marks", lambda df: df.agg(metrics.log_loss(F.col("y"), F.col("p")).alias("v")), {"v": f"-avg(y * ln({_CLIP.format(p='p')}) + (1 - y) * ln(1 - {_CLIP.format(p='p')}))"}),
    "metric_multi_log_loss": _row(
        "marks", lambda df: df.agg(metrics.multi_log_loss(F.col("k"), {0: F.col("p") / 2, 1: (1 - F.col("p")) / 2, 2: F.lit(0.5)}).alias("v")), {"v": "-avg(CASE k " + " ".join(f"WHEN {k} THEN ln({_CLIP.format(p=p)})" for k, p in _MULTI_P.items()) + " END)"}
    ),
    "metric_auc": (
        query("marks", lambda df: metrics.auc(df, "y", "p").select(tidy(F.col("auc")).alias("auc"))),
        f"SELECT {tidy_sql('(sum(CASE WHEN y = 1 THEN r END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2) / (count_if(y = 1) * count_if(y = 0))')} AS auc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM {_MARKS})",
    ),
    "metric_mae": _agg("preds", metrics.mae, "avg(abs(y - p))"),
    "metric_mse": _agg("preds", metrics.mse, "avg((y - p) * (y - p))"),
    "metric_rmse": _agg("preds", metrics.rmse, "sqrt(avg((y - p) * (y - p)))"),
    "metric_r2": _agg("preds", metrics.r2, "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))"),
    "metric_exp_rmse": _row("marks", lambda df: df.agg(metrics.exp_rmse(F.col("y") * 50, F.col("p") * 50).alias("v")), {"v": "exp(-sqrt(avg((y * 50 - p * 50) * (y * 50 - p * 50))) / 100)"}),
    "profile_dataset_stats": _row(
        "cats", lambda df: profile.dataset_stats(df, ["y", "fold"], ["c", "d"]),
        {"n_samples": "count(*)", "n_features": "4", "n_numeric": "2", "n_categorical": "2", "feature_ratio": "4 / count(*)", "density": "(count(y) + count(fold) + count(c) + count(d)) / (count(*) * 4)"},
    ),
    "profile_missing": _row("cats", lambda df: profile.missing(df, ["c", "d", "y"]), {"missing": "count_if(c IS NULL) + count_if(d IS NULL)", "ratio": "(count_if(c IS NULL) + count_if(d IS NULL)) / (count(*) * 3)", "columns": "2"}),
    "profile_outlier_iqr": (
        query("pairs", lambda df: profile.outlier_ratio(df, ["a", "b"]).select(tidy(F.col("outlier_ratio")).alias("v"))),
        f"""WITH x AS (SELECT * FROM {_PAIRS}), q AS (SELECT quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.75) AS a3, quantile_cont(b, 0.25) AS b1, quantile_cont(b, 0.75) AS b3 FROM x)
        SELECT {tidy_sql("(count_if(a < a1 - 1.5 * (a3 - a1) OR a > a3 + 1.5 * (a3 - a1)) + count_if(b < b1 - 1.5 * (b3 - b1) OR b > b3 + 1.5 * (b3 - b1))) / (count(*) * 2)")} AS v FROM x, q""",
    ),
    "profile_corr_mean": (
        query("obs", lambda df: profile.correlation_summary(df, ["latitude", "longitude", "y", "month"]).select(tidy(F.col("mean_correlation")).alias("mean_correlation"), tidy(F.col("high_ratio")).alias("high_ratio"))),
        f"""WITH r AS (SELECT unnest([corr(latitude, longitude), corr(latitude, y), corr(latitude, month), corr(longitude, y), corr(longitude, month), corr(y, month)]) AS r FROM {_OBS})
        SELECT {tidy_sql("avg(CASE WHEN r <> 0 THEN abs(r) END)")} AS mean_correlation, {tidy_sql("count_if(abs(r) > 0.8) / count(*)")} AS high_ratio FROM r""",
    ),
    "profile_corr_pairs": (
        query("obs", lambda df: profile.correlations(df, ["latitude", "longitude", "y"]).select("a", "b", tidy(F.col("r")).alias("r"))),
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {tidy_sql(f'corr({a}, {b})')} AS r FROM {_OBS}" for a, b in (("latitude", "longitude"), ("latitude", "y"), ("longitude", "y"))),
    ),
    "profile_skew": _row("obs", lambda df: profile.shape(df, ["latitude", "y"]), {"skewness": "(abs(skewness(latitude)) + abs(skewness(y))) / 2", "kurtosis": "(abs(kurtosis(latitude)) + abs(kurtosis(y))) / 2"}),
    "profile_mad_mean": (
        query("obs", lambda df: profile.median_deviation(df, ["latitude", "y"]).select(tidy(F.col("mad")).alias("mad"))),
        f"WITH x AS (SELECT * FROM {_OBS}), m AS (SELECT median(latitude) AS a, median(y) AS b FROM x) SELECT {tidy_sql('(avg(abs(latitude - a)) + avg(abs(y - b))) / 2')} AS mad FROM x, m",
    ),
    "profile_entropy_binned": (
        query("obs", lambda df: profile.binned_entropy(df, ["latitude", "y"]).select(tidy(F.col("entropy")).alias("entropy"))),
        "WITH "
        + ", ".join(f"{c}_x AS (SELECT *, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM {_OBS})" for c in ("latitude", "y"))
        + f" SELECT {tidy_sql('(' + ' + '.join(_ENTROPY.format(t=f'{c}_x', c=c, b=_BINS.format(c=c)) for c in ('latitude', 'y')) + ') / 2')} AS entropy",
    ),
    "profile_cat_metrics": (
        query("cats", lambda df: profile.categorical(df, ["c", "d"]).select("column", F.col("cardinality"), tidy(F.col("entropy")).alias("entropy"), "mode_count", tidy(F.col("mode_share")).alias("mode_share"))),
        f"""WITH x AS (SELECT * FROM {_CATS}), n AS (SELECT 'c' AS "column", c AS v, count(*) AS n FROM x WHERE c IS NOT NULL GROUP BY c UNION ALL SELECT 'd', d, count(*) FROM x WHERE d IS NOT NULL GROUP BY d)
        SELECT "column", count(*) AS cardinality, {tidy_sql("log2(sum(n)) - sum(n * log2(n)) / sum(n)")} AS entropy, max(n) AS mode_count, {tidy_sql("max(n) / sum(n)")} AS mode_share FROM n GROUP BY "column" """,
    ),
    "profile_target_clf": (
        query("cats", lambda df: (r := profile.target_classes(df, "c")).select(*[tidy(F.col(c)).alias(c) for c in r.columns])),
        f"WITH n AS (SELECT count(*) AS n FROM {_CATS} WHERE c IS NOT NULL GROUP BY c), s AS (SELECT n, n / sum(n) OVER () AS s FROM n) SELECT "
        + ", ".join(f"{tidy_sql(v)} AS {k}" for k, v in {"n_classes": "count(*)", "share_std": "stddev_samp(s)", "majority": "max(s)", "minority": "min(s)", "balance": "max(n) / min(n)"}.items())
        + " FROM s",
    ),
    "profile_target_reg": _row("obs", lambda df: profile.target_numbers(df, "y"), {"mean": "avg(y)", "std": "stddev_samp(y)", "min": "min(y)", "max": "max(y)", "skewness": "skewness(y)"}),
    "profile_sparsity": _row("pairs", lambda df: profile.sparsity(df, ["a", "b"]), {"sparsity": "(count_if(a = 0) + count_if(b = 0)) / (count(*) * 2)"}),
    "profile_complexity": (
        query("cats", _complexity),
        f"SELECT {tidy_sql('greatest(least(5 + greatest(least(log10(greatest(count(*), 100) / 1e4), 2), -2) + greatest(least(log10(10 / 50e0), 2), -2) + CASE WHEN abs(skewness(y)) > 1 THEN least(1.5, 0.7 * ln(abs(skewness(y)))) ELSE 0 END + 0.75 + 2 * count_if(c IS NULL) / count(*) + 0.2 + 0.1 + 0.6, 10), 1)')} AS v FROM {_CATS}",
    ),
    "shift_ks": (
        query("halves", lambda df: shift.kolmogorov_smirnov(df, "v").select(tidy(F.col("statistic")).alias("statistic"), tidy(F.col("p_value")).alias("p_value"))),
        f"""{_CDF}, d AS (SELECT max(abs(f - g)) AS d, max(n) AS n, max(m) AS m FROM s), r AS (SELECT d, sqrt(n * m / (n + m)) * d AS r FROM d)
        SELECT {tidy_sql("d")} AS statistic, {tidy_sql("CASE WHEN r < 0.2 THEN 1 ELSE greatest(least((SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * k * k * r * r)) FROM range(1, 101) t(k)), 1), 0) END")} AS p_value FROM r""",
    ),
    "shift_wasserstein": (query("halves", lambda df: shift.wasserstein(df, "v").select(tidy(F.col("distance")).alias("distance"))), f"{_CDF} SELECT {tidy_sql('sum(abs(f - g) * (nx - v))')} AS distance FROM s"),
    "shift_chi2": (
        query("halves", lambda df: shift.chi_square(df, "g").select(tidy(F.col("statistic")).alias("statistic"), "dof")),
        f"""WITH c AS (SELECT count_if(train = 1) AS a, count_if(train = 0) AS b FROM {_HALVES} GROUP BY g), t AS (SELECT a, b, sum(a) OVER () AS n, sum(b) OVER () AS m FROM c)
        SELECT {tidy_sql("sum(pow(a - (a + b) * n / (n + m), 2) / ((a + b) * n / (n + m)) + pow(b - (a + b) * m / (n + m), 2) / ((a + b) * m / (n + m)))")} AS statistic, count(*) - 1 AS dof FROM t""",
    ),
    "shift_dist_table": (
        query("halves", lambda df: shift.distribution(df, "g").select("g", tidy(F.col("train_share")).alias("train_share"), tidy(F.col("test_share")).alias("test_share"))),
        f"SELECT g, {tidy_sql('count_if(train = 1) / (sum(count_if(train = 1)) OVER ())')} AS train_share, {tidy_sql('count_if(train = 0) / (sum(count_if(train = 0)) OVER ())')} AS test_share FROM {_HALVES} GROUP BY g",
    ),
    "shift_report": (
        query("halves", lambda df: shift.report(df, ["v", "row_id"]).select("column", *[tidy(F.col(c)).alias(c) for c in ("train_mean", "test_mean", "train_std", "test_std")], "alert")),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", {", ".join(f"{tidy_sql(f'{f}({c}) FILTER (train = {k})')} AS {n}" for n, f, k in (("train_mean", "avg", 1), ("test_mean", "avg", 0), ("train_std", "stddev_samp", 1), ("test_std", "stddev_samp", 0)))},
            abs(avg({c}) FILTER (train = 1) - avg({c}) FILTER (train = 0)) > 0.1 * stddev_samp({c}) FILTER (train = 1) AS alert FROM {_HALVES}"""
            for c in ("v", "row_id")
        ),
    ),
    "weight_temporal": (
        _temporal,
        f"""WITH x AS (SELECT * FROM {_OBS}), a AS (SELECT * FROM x WHERE row_id % 4 <> 0), b AS (SELECT * FROM x WHERE row_id % 4 = 0 AND month IN (1, 2)),
        am AS (SELECT month, count(*) / (SELECT count(*) FROM a) AS s FROM a GROUP BY month), bm AS (SELECT month, count(*) / (SELECT count(*) FROM b) AS s FROM b GROUP BY month),
        ah AS (SELECT hour, count(*) / (SELECT count(*) FROM a) AS s FROM a GROUP BY hour), bh AS (SELECT hour, count(*) / (SELECT count(*) FROM b) AS s FROM b GROUP BY hour),
        w AS (SELECT row_id, coalesce(bm.s / am.s, 0.01) * coalesce(bh.s / ah.s, 0.01) AS w FROM a JOIN am USING (month) LEFT JOIN bm USING (month) JOIN ah USING (hour) LEFT JOIN bh USING (hour))
        SELECT row_id, {tidy_sql("w / (SELECT avg(w) FROM w)")} AS weight FROM w""",
    ),
    "weight_inverse_sqrt_count": (
        query("obs", lambda df: shift.crowding_weights(df, ["latitude", "longitude"]).select("row_id", tidy(F.col("weight")).alias("weight"))),
        f"SELECT row_id, {tidy_sql('1 / sqrt(count(*) OVER (PARTITION BY latitude, longitude))')} AS weight FROM {_OBS}",
    ),
    "weight_boosted": (
        query("obs", lambda df: df.select("row_id", tidy(shift.boosted(shift.combined(F.col("y") / 50, F.col("hour") / 24), F.col("month") == 1)).alias("weight"))),
        f"SELECT row_id, {tidy_sql('greatest(least((0.7e0 * (y / 50) + 0.3e0 * (hour / 24)) * CASE WHEN month = 1 THEN 2.5e0 ELSE 1 END, 15), 0.1e0)')} AS weight FROM {_OBS}",
    ),
    "weight_summary": _row("obs", lambda df: shift.summary(df, "y"), {"mean": "avg(y)", "std": "stddev_pop(y)", "min": "min(y)", "max": "max(y)"}),
    "importance_pearson": (
        query("obs", lambda df: importance.pearson(df, ["latitude", "longitude", "month"], "y").select("feature", tidy(F.col("value")).alias("value"))),
        " UNION ALL ".join(f"SELECT '{c}' AS feature, {tidy_sql(f'abs(corr({c}, y))')} AS value FROM {_OBS}" for c in ("latitude", "longitude", "month")),
    ),
    "importance_spearman": (
        query("obs", lambda df: importance.spearman(df, ["latitude", "month"], "y").select("feature", tidy(F.col("value")).alias("value"))),
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {tidy_sql('abs(corr(r, s))')} AS value FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS s FROM {_OBS} WHERE {c} IS NOT NULL AND y IS NOT NULL)"
            for c in ("latitude", "month")
        ),
    ),
    "importance_binned_mi": (
        query("obs", lambda df: importance.mutual_information(df, ["latitude", "month"], "y").select("feature", tidy(F.col("value")).alias("value"))),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, (WITH e AS (SELECT min({c}) AS l, max({c}) AS h, min(y) AS k, max(y) AS i FROM {_OBS} WHERE {c} IS NOT NULL AND y IS NOT NULL), b AS (SELECT least(floor(({c} - l) / ((h - l) / 10)), 9) AS a, least(floor((y - k) / ((i - k) / 10)), 9) AS b FROM {_OBS}, e WHERE {c} IS NOT NULL AND y IS NOT NULL),
            n AS (SELECT a, b, count(*) AS n FROM b GROUP BY a, b), t AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS nn FROM n) SELECT {tidy_sql("sum(n / nn * ln(n * nn / (na * nb)))")} FROM t) AS value"""
            for c in ("latitude", "month")
        ),
    ),
    "importance_aggregate_median": (
        query("cats", lambda df: importance.aggregate(_scored(df), {"count": 0.6, "mean": 0.4}).select("feature", tidy(F.col("value")).alias("value"))),
        f"""WITH v AS (SELECT coalesce(c, 'none') AS feature, count(*) AS n, avg(y) AS m FROM {_CATS} GROUP BY 1), s AS (SELECT feature, 0.6 * n / (SELECT median(n) FROM v WHERE n > 0) + 0.4 * m / (SELECT median(m) FROM v WHERE m > 0) AS s FROM v) SELECT feature, {tidy_sql("s")} AS value FROM s""",
    ),
    "importance_aggregate_softmax": (
        query("cats", lambda df: importance.aggregate(_scored(df).withColumn("value", F.col("value") / 1e3), {"count": 0.6, "mean": 0.4}, normalise=True).select("feature", tidy(F.col("value")).alias("value"))),
        f"""WITH v AS (SELECT coalesce(c, 'none') AS feature, count(*) / 1e3 AS n, avg(y) / 1e3 AS m FROM {_CATS} GROUP BY 1), s AS (SELECT feature, 0.6 * exp(n) / sum(exp(n)) OVER () + 0.4 * exp(m) / sum(exp(m)) OVER () AS s FROM v) SELECT feature, {tidy_sql("exp(s) / sum(exp(s)) OVER ()")} AS value FROM s""",
    ),
    "importance_jaccard_stability": (
        query("obs", lambda df: importance.stability(_ranked(df), 3).select("method", tidy(F.col("stability")).alias("stability"))),
        f"""WITH r AS (SELECT hour % 4 AS fold, month AS feature, row_number() OVER (PARTITION BY hour % 4 ORDER BY avg(y) DESC, month) AS k FROM {_OBS} GROUP BY 1, 2), t AS (SELECT * FROM r WHERE k <= 3),
        p AS (SELECT a.fold AS f, b.fold AS g, (SELECT count(*) FROM t x JOIN t z ON x.feature = z.feature WHERE x.fold = a.fold AND z.fold = b.fold) AS c FROM (SELECT DISTINCT fold FROM t) a JOIN (SELECT DISTINCT fold FROM t) b ON a.fold < b.fold)
        SELECT 'mean' AS method, {tidy_sql("avg(c / (6 - c))")} AS stability FROM p""",
    ),
}


def _scored(df):
    """(feature, method, value) of each category, for aggregation."""
    flat = df.groupBy(F.coalesce("c", F.lit("none")).alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))
    return flat.select("feature", F.inline(F.array(F.struct(F.lit("count").alias("method"), F.col("n").cast("double").alias("value")), F.struct(F.lit("mean").alias("method"), F.col("m").alias("value")))))


def _ranked(df):
    """(method, fold, feature, value): a month's mean in each of four folds."""
    return df.groupBy((F.col("hour") % 4).alias("fold"), F.col("month").cast("string").alias("feature"), F.col("month")).agg(F.avg("y").alias("value")).select(F.lit("mean").alias("method"), "fold", F.lpad("feature", 2, "0").alias("feature"), "value")

"""Scalar functions, a query each."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomtab.functions import numeric, other
from loomtab.queries.base import inline, query, tidy, tidy_sql

_UNARY = {
    "neg": "-a", "abs": "abs(a)", "square": "CASE WHEN abs(a) < 1e7 THEN a * a END", "cube": "CASE WHEN abs(a) < 1e7 THEN a * a * a END", "sqrt": "CASE WHEN a >= 0 THEN sqrt(a) END",
    "log": "CASE WHEN a > 0 THEN ln(a) END", "exp": "CASE WHEN abs(a) <= 50 THEN exp(a) END", "inv": "CASE WHEN abs(a) > 1e-15 AND abs(1 / a) < 1e15 THEN 1 / a END", "sin": "sin(a)", "cos": "cos(a)",
    "tan": "CASE WHEN abs(tan(a)) < 1e10 THEN tan(a) END", "sigmoid": "CASE WHEN abs(a) <= 50 THEN 1 / (1 + exp(-a)) WHEN a > 50 THEN 1 ELSE 0 END", "tanh": "tanh(a)",
    "reciprocal_sqrt": "CASE WHEN a > 1e-15 AND a < 1e15 THEN 1 / sqrt(a) END", "log10": "CASE WHEN a > 0 THEN log10(a) END", "log2": "CASE WHEN a > 0 THEN log2(a) END", "cbrt": "cbrt(a)", "floor": "floor(a)",
    "ceil": "ceil(a)", "round": "round_even(a, 0)", "sign": "sign(a)", "arcsin": "CASE WHEN a IS NOT NULL THEN asin(greatest(least(a, 1), -1)) END", "arccos": "CASE WHEN a IS NOT NULL THEN acos(greatest(least(a, 1), -1)) END", "arctan": "atan(a)",
}
_RATIO = "CASE WHEN abs(b) > 1e-15 AND abs(a / b) < 1e15 THEN a / b END"
_BINARY = {
    "add": "a + b", "sub": "a - b", "absdiff": "abs(a - b)", "diff_ratio": "CASE WHEN a + b <> 0 THEN (a - b) / (abs(a + b) + 1e-15) END", "mul": "CASE WHEN abs(a * b) < 1e15 THEN a * b END", "div": _RATIO,
    "logmul": "CASE WHEN a > 0 AND b > 0 AND a * b < 1e15 THEN ln(1 + abs(a * b)) END",
    "pow": "CASE WHEN abs(b) < 10 AND abs(a) < 1e10 AND (a >= 0 OR abs(b - round_even(b, 0)) < 1e-10) AND NOT (a = 0 AND b < 0) AND abs(pow(abs(a), b)) < 1e15 THEN CASE WHEN a < 0 AND abs(round_even(b, 0)) % 2 = 1 THEN -pow(-a, b) ELSE pow(abs(a), b) END END",
    "mod": "CASE WHEN abs(b) > 1e-15 THEN a - b * floor(a / b) END", "max": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END", "min": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END",
    "mean": "(a + b) / 2", "geometric_mean": "CASE WHEN a > 0 AND b > 0 THEN sqrt(a * b) END", "harmonic_mean": "CASE WHEN a > 0 AND b > 0 THEN 2 / (1 / a + 1 / b) END",
    "relative_diff": "CASE WHEN abs(b) > 1e-15 THEN (a - b) / abs(b) END", "percent_change": "CASE WHEN abs(b) > 1e-15 THEN 100 * ((a - b) / abs(b)) END", "ratio": _RATIO, "distance_euclidean": "sqrt((a - b) * (a - b))",
    "distance_manhattan": "abs(a - b)", "angle_between": "atan2(b, a)", "weighted_sum": "0.7e0 * a + 0.3e0 * b", "weighted_diff": "0.7e0 * a - 0.3e0 * b",
}
_UNARY2 = {
    "log": "ln(abs(a) + 1e-8)", "log10": "log10(abs(a) + 1e-8)", "log2": "log2(abs(a) + 1e-8)", "sqrt": "sqrt(abs(a))", "square": "a * a", "cube": "a * a * a", "inverse": "1 / (a + 1e-8)",
    "yeo_johnson": "CASE WHEN a >= 0 THEN (pow(abs(a) + 1, 0.5e0) - 1) / 0.5e0 WHEN a < 0 THEN -(pow(1 - a, 1.5e0) - 1) / 1.5e0 END", "log1p": "ln(1 + abs(a))", "power_2": "sign(a) * sqrt(abs(a))", "power_3": "sign(a) * cbrt(abs(a))",
}
_BINARY2 = {
    "power": "CASE WHEN a IS NOT NULL AND b IS NOT NULL AND NOT (a = 0 AND b < 0) AND pow(least(abs(a), 1e5), b) < 1e15 THEN CASE WHEN a < 0 AND abs(round_even(b, 0)) % 2 = 1 THEN -1 ELSE 1 END * pow(least(abs(a), 1e5), b) END",
    "harmonic_mean": "2 / nullif(1 / nullif(a + 1e-8, 0) + 1 / nullif(b + 1e-8, 0), 0)", "euclidean": "abs(a - b)", "greater": "CASE WHEN a > b THEN 1 ELSE 0 END", "less": "CASE WHEN a < b THEN 1 ELSE 0 END", "equal": "CASE WHEN abs(a - b) < 1e-6 THEN 1 ELSE 0 END",
    "not_equal": "CASE WHEN abs(a - b) >= 1e-6 THEN 1 ELSE 0 END", "weighted_sum_06_04": "0.6e0 * a + 0.4e0 * b",
}
_DATES = {
    "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "hour": "hour(ts)", "minute": "minute(ts)", "dayofweek": "isodow(ts) - 1", "dayofyear": "dayofyear(ts)", "quarter": "quarter(ts)",
    "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END", "is_month_end": "CASE WHEN CAST(ts AS DATE) = last_day(ts) THEN 1 ELSE 0 END", "is_month_start": "CASE WHEN day(ts) = 1 THEN 1 ELSE 0 END", "week_of_year": "week(ts)",
}
_START = "TIMESTAMP '2024-01-15 12:30:00'"
_GAP = f"(epoch_us(ts) - epoch_us({_START}))"
_SPANS = {"days_diff": f"floor({_GAP} / 86400e6)", "years_diff": f"floor({_GAP} / 86400e6) / 365.25e0", "hours_diff": f"{_GAP} / 3600e6"}



def _num(build, sql: str, name: str, two: bool):
    a, b = (lambda: numeric.number(F.col("a"))), (lambda: numeric.number(F.col("b")))
    value = (lambda: build(a(), b())) if two else (lambda: build(a()))
    return query("pairs", lambda df: df.select("row_id", tidy(value()).alias(name))), f"SELECT row_id, {tidy_sql(sql)} AS {name} FROM {inline('pairs')}"


def _events(build):
    return lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _date(name: str):
    made = lambda df: df.select("event_id", other.DATE_UNARY[name](F.col("ts")).cast("double").alias("v"))
    return _events(made), f"SELECT event_id, CAST({_DATES[name]} AS DOUBLE) AS v FROM events"


def _span(name: str):
    made = lambda df: df.select("event_id", tidy(other.DATE_BINARY[name](F.col("ts"), F.lit("2024-01-15 12:30:00").cast("timestamp_ntz"))).alias("v"))
    return _events(made), f"SELECT event_id, {tidy_sql(_SPANS[name])} AS v FROM events"


def _cyclic(df):
    return df.select("row_id", *[tidy(v).alias(f"{c}_{f}") for c, p in other.PERIODS.items() for f, v in zip(("sin", "cos"), other.cyclic(F.col(c), p))])


def _parse(df):
    return df.select("row_id", *[tidy(f(F.col(c))).alias(f"{c}_{n}") for c in ("plain", "grouped", "percent") for n, f in (("plain", other.plain_number), ("grouped", other.grouped_number), ("share", other.percentage))])


_NUMBER = {"plain": "TRY_CAST({c} AS DOUBLE)", "grouped": "TRY_CAST(replace({c}, ',', '') AS DOUBLE)", "share": "TRY_CAST(regexp_replace({c}, '[\\s%]', '', 'g') AS DOUBLE) / 100"}

ENTRIES = {
    **{f"num_{k}": _num(numeric.UNARY[k], sql, f"a_{k}", False) for k, sql in _UNARY.items()},
    **{f"num2_{k}": _num(numeric.BINARY[k], sql, f"a_{k}_b", True) for k, sql in _BINARY.items()},
    **{f"v2_{k}": _num(numeric.UNARY2[k], sql, f"a_{k}", False) for k, sql in _UNARY2.items()},
    **{f"v2_{k}": _num(numeric.BINARY2[k], sql, f"a_{k}_b", True) for k, sql in _BINARY2.items()},
    **{f"date_{k}": _date(k) for k in _DATES},
    **{f"date_{k}": _span(k) for k in _SPANS},
    "cat_concat": (query("cats", lambda df: df.select("row_id", other.concat(F.col("c"), F.col("d")).alias("c_concat_d"))), f"SELECT row_id, coalesce(c, 'nan') || '_' || coalesce(d, 'nan') AS c_concat_d FROM {inline('cats')}"),
    "cat_match": (query("cats", lambda df: df.select("row_id", other.match(F.col("c"), F.col("d")).alias("v"))), f"SELECT row_id, CASE WHEN c = d THEN 1e0 ELSE 0e0 END AS v FROM {inline('cats')}"),
    "cat_mismatch": (query("cats", lambda df: df.select("row_id", other.mismatch(F.col("c"), F.col("d")).alias("v"))), f"SELECT row_id, CASE WHEN c = d THEN 0e0 ELSE 1e0 END AS v FROM {inline('cats')}"),
    "parse_numeric": (query("texts", _parse), "SELECT row_id, " + ", ".join(f"{tidy_sql(_NUMBER[n].format(c=c))} AS {c}_{n}" for c in ("plain", "grouped", "percent") for n in _NUMBER) + f" FROM {inline('texts')}"),
    "cyclic_encode": (query("obs", _cyclic), "SELECT row_id, " + ", ".join(f"{tidy_sql(f'{f}({c} * {2 * math.pi / p!r})')} AS {c}_{f}" for c, p in other.PERIODS.items() for f in ("sin", "cos")) + f" FROM {inline('obs')}"),
    "synthetic_timestamp": (
        query("obs", lambda df: df.select("row_id", other.synthetic_timestamp(F.col("day_of_year") + 2, F.col("hour")).alias("ts"))),
        f"SELECT row_id, CASE WHEN day_of_year + 2 <= 365 THEN TIMESTAMP '2023-01-01 00:00:00' + to_days(day_of_year + 1) + to_hours(hour) END AS ts FROM {inline('obs')}",
    ),
    "clean_inf": (query("pairs", lambda df: df.select("row_id", tidy(numeric.finite(F.col("a"))).alias("a"), tidy(numeric.bounded(F.col("b"))).alias("b"), tidy(numeric.clip(F.col("a"), -1.0, 1.0)).alias("c"))), f"SELECT row_id, {tidy_sql('coalesce(a, 0)')} AS a, {tidy_sql('coalesce(b, 0)')} AS b, {tidy_sql('CASE WHEN a IS NOT NULL THEN greatest(least(a, 1), -1) END')} AS c FROM {inline('pairs')}"),
}

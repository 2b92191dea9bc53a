"""Encoders and preparation, a query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.operators import encoders, prepare
from loomtab.queries.base import inline, query, tidy, tidy_sql

_CATS = inline("cats")
_WEIGHT = "(1 / (1 + exp(-({n} - 20e0) / 10e0)))"


def _blend(s: str, n: str, prior: str) -> str:
    w = _WEIGHT.format(n=n)
    return f"{prior} * (1 - {w}) + coalesce({s} / nullif({n}, 0), {prior}) * {w}"


def _encoded(kind: str):
    def build(df):
        encoder = encoders.CategoricalEncoder(**{kind: ["c", "d"]}, label="y").fit(df.where("fold < 4"))
        return encoder.transform(df).select("row_id", tidy(F.col(f"c_{kind}")).alias("c"), tidy(F.col(f"d_{kind}")).alias("d"))

    value = {"target": _blend("s", "n", "prior"), "count": "n", "freq": "n / total"}[kind]
    unknown = {"target": "prior", "count": "0", "freq": "0"}[kind]
    table = lambda c: f"{c}t AS (SELECT {c} AS k, {value} AS v FROM (SELECT {c}, count(*) AS n, sum(y) AS s FROM x WHERE fold < 4 GROUP BY {c}), p)"
    sql = f"""WITH x AS (SELECT * FROM {_CATS}), p AS (SELECT avg(y) AS prior, count(*) AS total FROM x WHERE fold < 4), {table("c")}, {table("d")}
        SELECT row_id, {tidy_sql(f"coalesce(ct.v, {unknown})")} AS c, {tidy_sql(f"coalesce(dt.v, {unknown})")} AS d FROM x CROSS JOIN p LEFT JOIN ct ON x.c IS NOT DISTINCT FROM ct.k LEFT JOIN dt ON x.d IS NOT DISTINCT FROM dt.k"""
    return query("cats", build), sql


def _prep(build, columns: dict[str, str], source: str = "texts"):
    return query(source, lambda df: build(df)), "SELECT row_id, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {inline(source)}"


def _over(sql: str, source: str = "texts") -> str:
    return f"(SELECT {sql} FROM {inline(source)})"


_CLEAN = "CASE WHEN s IN ('-', '', ' ', 'NaN', 'nan', 'Nan', 'NAN', 'Unknown', 'unknown') THEN NULL ELSE s END"

ENTRIES = {
    "enc_target": _encoded("target"),
    "enc_count": _encoded("count"),
    "enc_freq": _encoded("freq"),
    "enc_target_oof": (
        query("cats", lambda df: encoders.target_out_of_fold(df, "c", "y", "fold").select("row_id", tidy(F.col("c_target")).alias("c_target"))),
        f"""WITH x AS (SELECT * FROM {_CATS}), o AS (SELECT a.fold, b.c, (SELECT avg(y) FROM x WHERE x.fold <> a.fold) AS prior, b.s, b.n FROM (SELECT DISTINCT fold FROM x) a JOIN LATERAL (SELECT c, sum(y) AS s, count(y) AS n FROM x WHERE x.fold <> a.fold GROUP BY c) b ON true)
            SELECT row_id, {tidy_sql("coalesce(" + _blend("o.s", "o.n", "o.prior") + ", (SELECT avg(y) FROM x z WHERE z.fold <> x.fold))")} AS c_target FROM x LEFT JOIN o ON x.fold = o.fold AND x.c IS NOT DISTINCT FROM o.c""",
    ),
    "enc_ordinal": (
        query("cats", lambda df: encoders.ordinal(df.where("c <> 'view'"), df, "c").select("row_id", "c_code")),
        f"WITH x AS (SELECT * FROM {_CATS}) SELECT row_id, CAST(coalesce(k, -1) AS INT) AS c_code FROM x LEFT JOIN (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM x WHERE c <> 'view' GROUP BY c) USING (c)",
    ),
    "enc_onehot": (
        query("cats", lambda df: encoders.one_hot(df.where("c IN ('view', 'click')"), df, "c").select("row_id", "c_click", "c_view")),
        f"SELECT row_id, CASE WHEN c = 'click' THEN 1e0 ELSE 0e0 END AS c_click, CASE WHEN c = 'view' THEN 1e0 ELSE 0e0 END AS c_view FROM {_CATS}",
    ),
    "enc_label": (
        query("cats", lambda df: encoders.label_codes(df, "c", "row_id").select("row_id", "c_code")),
        f"WITH x AS (SELECT * FROM {_CATS}) SELECT row_id, CAST(k AS INT) AS c_code FROM x LEFT JOIN (SELECT c, row_number() OVER (ORDER BY min(row_id)) - 1 AS k FROM x WHERE c IS NOT NULL GROUP BY c) USING (c)",
    ),
    "impute_mean": _prep(lambda df: prepare.impute(df, df, ["v"], []).select("row_id", tidy(F.col("v")).alias("v")), {"v": tidy_sql(f"coalesce(v, {_over('avg(v)')})")}),
    "impute_median": _prep(lambda df: prepare.impute(df, df, ["v"], [], "median").select("row_id", tidy(F.col("v")).alias("v")), {"v": tidy_sql(f"coalesce(v, {_over('median(v)')})")}),
    "impute_mode": _prep(lambda df: prepare.impute(df, df, [], ["s"]).select("row_id", "s"), {"s": f"coalesce({_CLEAN}, (SELECT s FROM {inline('texts')} WHERE {_CLEAN} IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1))"}),
    "impute_sentinel": _prep(lambda df: df.select("row_id", prepare.missing(F.col("s")).alias("s")), {"s": _CLEAN}),
    "scale_minmax": _prep(lambda df: prepare.scale(df, df, ["v"]).select("row_id", tidy(F.col("v")).alias("v")), {"v": tidy_sql(f"(v - {_over('min(v)')}) / {_over('max(v) - min(v)')}")}),
    "scale_standard": _prep(lambda df: prepare.scale(df, df, ["v"], "standard").select("row_id", tidy(F.col("v")).alias("v")), {"v": tidy_sql(f"(v - {_over('avg(v)')}) / {_over('stddev_pop(v)')}")}),
    "infer_types": (
        query("texts", prepare.infer_types),
        f"""WITH x AS (SELECT * FROM {inline("texts")}), r AS (SELECT 'row_id' AS "column", true AS num UNION ALL SELECT 'v', true """
        + "".join(
            f"""UNION ALL SELECT '{c}', NOT (count(DISTINCT {c}) / count(*) < 0.1) AND (count_if({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) = 0 OR count_if({c} IS NOT NULL AND TRY_CAST(replace({c}, ',', '') AS DOUBLE) IS NULL) = 0
            OR count_if({c} IS NOT NULL AND TRY_CAST(regexp_replace({c}, '[\\s%]', '', 'g') AS DOUBLE) IS NULL) = 0) FROM x """
            for c in ("s", "plain", "grouped", "percent")
        )
        + """) SELECT "column", CASE WHEN num THEN 'num' ELSE 'cat' END AS role FROM r""",
    ),
}

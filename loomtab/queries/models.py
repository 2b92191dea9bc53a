"""Catalog transforms and fitted models, a query each; fits have no SQL."""

from __future__ import annotations

from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.operators import folds, models
from loomtab.operators.search import FeatureSearch
from loomtab.plans.catalog import Catalog
from loomtab.queries.base import inline, query, tidy, tidy_sql

_FEATURES = ["latitude", "longitude", "hour", "month"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price features of line items: a logarithm, a unit price and an encoded flag."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    catalog = Catalog.of(items, leave=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    catalog.add("log", "l_extendedprice")
    catalog.add("log", catalog.add("div", "l_extendedprice", "l_quantity").name)
    catalog.add("freq", "l_returnflag")
    made = catalog.fit(items).transform(items)
    names = ["l_extendedprice_log", "l_extendedprice_div_l_quantity", "l_extendedprice_div_l_quantity_log", "l_returnflag_freq"]
    return made.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[tidy(F.col(n)).alias(n) for n in names])


_FLAGSHIP = f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {tidy_sql("CASE WHEN l_extendedprice > 0 THEN ln(l_extendedprice) END")} AS l_extendedprice_log, {tidy_sql("CASE WHEN abs(l_quantity) > 1e-15 THEN l_extendedprice / l_quantity END")} AS l_extendedprice_div_l_quantity,
    {tidy_sql("CASE WHEN l_quantity <> 0 AND l_extendedprice / l_quantity > 0 THEN ln(l_extendedprice / l_quantity) END")} AS l_extendedprice_div_l_quantity_log, {tidy_sql("(count(*) OVER (PARTITION BY l_returnflag)) / (count(*) OVER ())")} AS l_returnflag_freq FROM lineitem"""


def _kmeans(df: DataFrame) -> DataFrame:
    placed, _ = models.clusters(df.select("row_id", "latitude", "longitude"), ["latitude", "longitude"], 5)
    return placed.select("row_id", "cluster")


def _cross_val(df: DataFrame) -> DataFrame:
    found = models.cross_validate(folds.kfold(df, 3), _FEATURES, "y", DecisionTreeRegressor(maxDepth=4, seed=1))
    return df.sparkSession.createDataFrame([(int(k), float(v)) for k, v in found["scores"].items()], "fold int, rmse double")


def _search(df: DataFrame) -> DataFrame:
    rows = folds.kfold(df.select("row_id", "latitude", "longitude", "hour", (F.col("y") + F.col("latitude") * F.col("hour")).alias("y")), 3).persist()
    search = FeatureSearch("y", model=DecisionTreeRegressor(maxDepth=4, seed=1), generations=1, parents=6, children=30, stop_children=3, max_new=2, leave=("row_id",))
    catalog = search.search(rows)
    made = [(f.name, f.op, f.depth) for f in catalog.features.values() if f.op]
    rows.unpersist()
    return df.sparkSession.createDataFrame(made, "name string, op string, depth int")


def _stack(df: DataFrame) -> DataFrame:
    made, _ = models.stack(folds.kfold(df, 2), _FEATURES, "y", {"tree": DecisionTreeRegressor(maxDepth=4, seed=1), "line": LinearRegression(regParam=0.1)})
    return made.select("row_id", "tree", "line", "blend")


ENTRIES = {
    "catalog_features": (flagship, _FLAGSHIP),
    "catalog_categories": (
        query("cats", lambda df: _categories(df).select("row_id", "c_concat_d", tidy(F.col("c_concat_d_count")).alias("n"))),
        f"WITH x AS (SELECT row_id, coalesce(c, 'nan') || '_' || coalesce(d, 'nan') AS c_concat_d FROM {inline('cats')}) SELECT row_id, c_concat_d, {tidy_sql('count(*) OVER (PARTITION BY c_concat_d)')} AS n FROM x",
    ),
    "model_blend": (
        query("marks", lambda df: df.select("row_id", tidy(models.blend(["p", "k", "m"], [0.5, 0.3, 0.2])).alias("v"))),
        f"SELECT row_id, {tidy_sql('p * 0.5e0 + k * 0.3e0 + m * 0.2e0')} AS v FROM {inline('marks')}",
    ),
    "model_rescale": (query("obs", lambda df: models.rescaled(df, "y", 100.0).select("row_id", tidy(F.col("y")).alias("y"))), f"SELECT row_id, {tidy_sql(f'y * (100e0 / (SELECT median(y) FROM {inline('obs')}))')} AS y FROM {inline('obs')}"),
    "model_tree_importance": (query("obs", lambda df: models.tree_importance(df, _FEATURES, "y")), None),
    "model_permutation_importance": (query("obs", lambda df: models.permutation_importance(df, _FEATURES[:2], "y", model=DecisionTreeRegressor(maxDepth=4, seed=1))), None),
    "model_kmeans": (query("obs", _kmeans), None),
    "model_cross_val": (query("obs", _cross_val), None),
    "model_search": (query("obs", _search), None),
    "model_stacking": (query("obs", _stack), None),
    "model_adversarial": (query("obs", lambda df: models.adversarial(df.where("row_id % 3 > 0"), df.where("row_id % 3 = 0"), _FEATURES)), None),
}


def _categories(df: DataFrame) -> DataFrame:
    catalog = Catalog.of(df.select("c", "d"))
    catalog.add("count", catalog.add("concat", "c", "d").name)
    return catalog.fit(df).transform(df)

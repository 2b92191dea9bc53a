"""Models over feature frames: cross-validation, importances, clusters, stacking, adversarial validation.

All fits are ``pyspark.ml`` estimators, swapped freely by a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.functions.numeric import finite
from loomtab.operators.folds import shuffled
from loomtab.operators.metrics import SCORERS, Scorer

SEED = 42


def vectors(df: DataFrame, features: list[str], label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(features, label, kept columns): what an estimator takes; missing and infinite values as 0."""
    rows = df.select(*[finite(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("label"), *keep).where("label IS NOT NULL")
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(rows).select("features", "label", *keep)


def default_model() -> Estimator:
    return GBTRegressor(maxIter=8, maxDepth=4, seed=SEED)


def cross_validate(df: DataFrame, features: list[str], label: str, model: Estimator | None = None, scorer: Scorer = SCORERS["rmse"], fold: str = "fold", prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None, weights: dict[int, float] | None = None) -> dict:
    """Score of each fold and their mean, weighted if asked; ``prepare`` (train, val) fits on a fold's training rows alone."""
    scores = {}
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):  # a row a fold
        train, val = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        if prepare:
            train, val = prepare(train, val)
        fitted = (model or default_model()).fit(vectors(train, features, label))
        scores[k] = scorer.score(fitted.transform(vectors(val, features, label)))
    w = {k: (weights or {}).get(k, 1.0) for k in scores}
    return {"scores": scores, "mean": sum(w[k] * s for k, s in scores.items()) / sum(w.values())}


def tree_importance(df: DataFrame, features: list[str], label: str, model: Estimator | None = None) -> DataFrame:
    """(feature, value): a boosted model's split gains; they add up to 1."""
    values = (model or default_model()).fit(vectors(df, features, label)).featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, value double")


def permutation_importance(df: DataFrame, features: list[str], label: str, key: str = "row_id", repeats: int = 1, model: Estimator | None = None, scorer: Scorer = SCORERS["rmse"]) -> DataFrame:
    """(feature, value): how much worse a fitted model scores when a column's values are dealt out anew.

    Rows are dealt in blocks: within a hash block each row gets the value of
    the next in hashed order, so no window holds all rows.
    """
    from pyspark.sql import Window

    rows = df.select(key, *features, label).persist()
    fitted = (model or default_model()).fit(vectors(rows, features, label))
    base = scorer.score(fitted.transform(vectors(rows, features, label)))
    out = []
    for f in features:
        worse = 0.0
        for r in range(repeats):
            ring = Window.partitionBy(F.pmod(F.xxhash64(F.lit(r), key), F.lit(64))).orderBy(shuffled(F.col(key), SEED + r))
            every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            moved = rows.withColumn(f, F.coalesce(F.lead(f).over(ring), F.first(f).over(every)))
            score = scorer.score(fitted.transform(vectors(moved, features, label)))
            worse += (base - score) if scorer.greater_is_better else (score - base)
        out.append((f, worse / repeats))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "feature string, value double")


def clusters(df: DataFrame, columns: list[str], k: int, seed: int = SEED) -> tuple[DataFrame, list[tuple[float, ...]]]:
    """``df`` with ``cluster`` (null where a coordinate is missing), and the centres."""
    known = df.dropna(subset=columns)
    fitted = KMeans(k=k, seed=seed).fit(VectorAssembler(inputCols=columns, outputCol="features").transform(known))
    from loomtab.operators.spatial import centroid_distances

    centres = [tuple(map(float, c)) for c in fitted.clusterCenters()]
    return centroid_distances(df, centres, columns).select(*df.columns, "cluster"), centres


def stack(df: DataFrame, features: list[str], label: str, models: dict[str, Estimator], key: str = "row_id", fold: str = "fold", ridge: float = 1.0) -> tuple[DataFrame, object]:
    """Out-of-fold predictions of several models, and the ridge that blends them: ((key, label, model..., blend), fitted ridge)."""
    base, names = None, list(models)
    for name, model in models.items():
        parts = None
        for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
            fitted = model.fit(vectors(df.where(F.col(fold) != k), features, label))
            one = fitted.transform(vectors(df.where(F.col(fold) == k), features, label, (key,))).select(key, "label", F.col("prediction").alias(name))
            parts = one if parts is None else parts.unionByName(one)
        base = parts if base is None else base.join(parts.drop("label"), key)
    blender = LinearRegression(regParam=ridge, elasticNetParam=0.0)
    joined = vectors(base, names, "label", (key, *names))
    fitted = blender.fit(joined)
    return fitted.transform(joined).select(key, "label", *names, F.col("prediction").alias("blend")), fitted


def adversarial(train: DataFrame, test: DataFrame, features: list[str], key: str = "row_id") -> DataFrame:
    """(key, likeness): how much each training row looks like a test row, by a model that tells the two apart."""
    both = train.select(key, *features, F.lit(0.0).alias("label")).unionByName(test.select(key, *features, F.lit(1.0).alias("label")))
    fitted = default_model().fit(vectors(both, features, "label"))
    return fitted.transform(vectors(train.withColumn("label", F.lit(0.0)), features, "label", (key,))).select(key, F.col("prediction").alias("likeness"))


def blend(columns: list[str], weights: list[float] | None = None):
    """A weighted mean of prediction columns; plain without weights."""
    weights = weights or [1 / len(columns)] * len(columns)
    return sum((F.col(c) * w for c, w in zip(columns[1:], weights[1:], strict=True)), F.col(columns[0]) * weights[0])


def inverse_error_weights(errors: dict[str, float], best: int = 3) -> dict[str, float]:
    """Weights of the best few models, by one over their error."""
    kept = sorted(errors, key=errors.get)[:best]
    total = sum(1 / errors[k] for k in kept)
    return {k: 1 / errors[k] / total for k in kept}


def rescaled(df: DataFrame, column: str, target_median: float, tolerance: float = 0.1) -> DataFrame:
    """Predictions scaled to a median if theirs is off by more than the tolerance."""
    median = df.agg(F.median(column)).first()[0]
    off = median and abs(median - target_median) > tolerance * abs(target_median)
    return df.withColumn(column, F.col(column) * (target_median / median)) if off else df

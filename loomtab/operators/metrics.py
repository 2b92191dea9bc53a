"""Evaluation metrics as aggregate expressions over a prediction table.

A frame is aggregated once for any number of metrics; by group or fold it is
``df.groupBy(...).agg(...)`` with the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFSET = 1e-8


def confusion(y: Column, label: Column, positive=1) -> dict[str, Column]:
    """Counts tp, fn, fp, tn for one positive class."""
    real, said = y == positive, label == positive
    return {"tp": F.count_if(real & said), "fn": F.count_if(real & ~said), "fp": F.count_if(~real & said), "tn": F.count_if(~real & ~said)}


def _one(y: Column, label: Column, positive=1) -> dict[str, Column]:
    c = confusion(y, label, positive)
    precision, recall = c["tp"] / (c["tp"] + c["fp"] + OFFSET), c["tp"] / (c["tp"] + c["fn"] + OFFSET)
    accuracy = (c["tp"] + c["tn"]) / (c["tp"] + c["tn"] + c["fp"] + c["fn"] + OFFSET)
    return {"accuracy": accuracy, "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall + OFFSET)}


def classification(y: Column, label: Column, classes: list | None = None) -> dict[str, Column]:
    """accuracy, precision, recall and f1; with ``classes`` the plain mean of each class against the rest."""
    if classes is None:
        return _one(y, label)
    each = [_one(y, label, k) for k in classes]
    return {m: sum((e[m] for e in each[1:]), each[0][m]) / len(each) for m in each[0]}


def log_loss(y: Column, p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - OFFSET)), F.lit(OFFSET))
    return -F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def multi_log_loss(y: Column, p: dict[object, Column]) -> Column:
    """Log loss of several classes' probabilities."""
    total = F.lit(0.0)
    for k, c in p.items():
        total = total + F.when(y == k, F.ln(F.greatest(F.least(c, F.lit(1 - OFFSET)), F.lit(OFFSET)))).otherwise(0.0)
    return -F.avg(total)


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def r2(y: Column, p: Column) -> Column:
    """1 for one row or none; a constant truth gives 1 if it is met and 0 if not."""
    rest, whole = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return F.when(F.count(y) <= 1, 1.0).when(whole == 0, F.when(rest == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(rest, whole))


def exp_rmse(y: Column, p: Column) -> Column:
    return F.exp(-rmse(y, p) / 100)


def regression(y: Column, p: Column) -> dict[str, Column]:
    return {"mae": mae(y, p), "mse": mse(y, p), "rmse": rmse(y, p), "r2": r2(y, p)}


def auc(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """(by, auc): rank-sum area under the ROC curve, ties sharing their mean rank.

    Scores are counted first, so the running sums go over distinct scores.
    """
    by = by or []
    cells = df.groupBy(*by, F.col(p).alias("__p")).agg(F.count_if(F.col(y) == 1).alias("__1"), F.count_if(F.col(y) == 0).alias("__0"))
    under = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    won = cells.select(*by, "__1", "__0", (F.col("__1") * (F.coalesce(F.sum("__0").over(under), F.lit(0)) + F.col("__0") / 2)).alias("__won"))
    return won.groupBy(*by).agg(F.try_divide(F.sum("__won"), F.sum("__1") * F.sum("__0")).alias("auc"))


class Scorer:
    """A metric with a name and a direction, as searches and cross-validation take it."""

    def __init__(self, name: str, metric: Callable[[Column, Column], Column], greater_is_better: bool, probability: bool = False):
        self.name, self.metric, self.greater_is_better, self.probability = name, metric, greater_is_better, probability

    def score(self, df: DataFrame, y: str = "label", p: str | None = None) -> float:
        """Over predictions, or for a metric of probabilities over those of label 1: the last of a classifier's ``probability``, else the prediction."""
        of = F.col(p or "prediction")
        if p is None and self.probability and "probability" in df.columns:
            of = F.element_at(vector_to_array("probability"), -1)
        return df.agg(self.metric(F.col(y), of).alias("v")).first().v

    def better(self, new: float, old: float) -> bool:
        return new > old if self.greater_is_better else new < old


def _rounded(metric: str) -> Callable[[Column, Column], Column]:
    return lambda y, p: _one(y, F.rint(p))[metric]


SCORERS = {
    "mae": Scorer("mae", mae, False),
    "mse": Scorer("mse", mse, False),
    "rmse": Scorer("rmse", rmse, False),
    "r2": Scorer("r2", r2, True),
    "exp_rmse": Scorer("exp_rmse", exp_rmse, True),
    **{m: Scorer(m, _rounded(m), True) for m in ("accuracy", "precision", "recall", "f1")},
    "log_loss": Scorer("log_loss", log_loss, False, True),
}


def weighted_mean(scores: Column, weights: Column) -> Column:
    """Fold scores averaged by weights that need not add up to one."""
    return F.try_divide(F.sum(scores * weights), F.sum(weights))

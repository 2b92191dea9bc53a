"""Categorical encoders: fitted as aggregations, applied as joins with small look-up tables.

A missing category is a value of its own; a category not seen in the fit gets
the prior (target) or zero (count, frequency).  Target means are drawn towards
the prior by a sigmoid of the category's count (Micci-Barreca, 2001), centred
at ``MIDDLE`` with width ``SPAN``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtab.operators.tables import attach

MIDDLE, SPAN = 20.0, 10.0


def blend(total: Column, count: Column, prior: Column, middle: float = MIDDLE, span: float = SPAN) -> Column:
    """Smoothed mean of a category from its sum and count."""
    weight = 1 / (1 + F.exp(-(count - middle) / span))
    return prior * (1 - weight) + F.try_divide(total, count) * weight


@dataclass
class CategoricalEncoder:
    """Target, count and frequency encodings of chosen columns.

    New columns follow the originals in the input's order, for each column
    target, count, frequency; names end in ``_target``, ``_count``, ``_freq``.
    """

    target: list[str] = field(default_factory=list)
    count: list[str] = field(default_factory=list)
    freq: list[str] = field(default_factory=list)
    label: str | None = None
    keep: bool = True
    middle: float = MIDDLE
    span: float = SPAN
    tables: dict[str, DataFrame] = field(default_factory=dict)
    prior: float | None = None

    def fit(self, df: DataFrame) -> CategoricalEncoder:
        """One aggregation a column; columns that ``df`` lacks are passed over."""
        wanted = [c for c in df.columns if c in {*self.target, *self.count, *self.freq}]
        if any(c in self.target for c in wanted) and not self.label:
            raise ValueError("target encoding needs a label")
        total = F.sum(self.label) if self.label else F.lit(None).cast("double")
        known = F.count(self.label) if self.label else F.lit(0)
        first = df.agg(F.count("*").alias("n"), (F.avg(self.label) if self.label else F.lit(None).cast("double")).alias("prior")).first()
        self.prior = first.prior
        for c in wanted:
            self.tables[c] = df.groupBy(c).agg(F.count("*").alias("__n"), total.alias("__sum"), known.alias("__known")).select(
                c,
                blend(F.col("__sum"), F.col("__known"), F.lit(first.prior), self.middle, self.span).alias(f"{c}_target"),
                F.col("__n").alias(f"{c}_count"),
                (F.col("__n") / F.lit(first.n)).alias(f"{c}_freq"),
            )
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        made = []
        base = df.columns
        for c in [c for c in base if c in self.tables]:
            fills = {"target": F.lit(self.prior), "count": F.lit(0), "freq": F.lit(0.0)}
            kinds = [k for k in ("target", "count", "freq") if c in getattr(self, k)]
            df = attach(df, self.tables[c].select(c, *[f"{c}_{k}" for k in kinds]), [c], null_is_key=True)
            made += [F.coalesce(f"{c}_{k}", fills[k]).alias(f"{c}_{k}") for k in kinds]
        old = base if self.keep else [c for c in base if c not in self.tables]
        return df.select(*old, *made)


def target_out_of_fold(df: DataFrame, column: str, label: str, fold: str, middle: float = MIDDLE, span: float = SPAN) -> DataFrame:
    """``df`` with ``<column>_target`` from the other folds' rows alone.

    One aggregation by category and fold serves all folds: a fold's training
    sums are the totals less its own.
    """
    cells = df.groupBy(column, fold).agg(F.sum(label).alias("s"), F.count(label).alias("n"))
    whole = cells.groupBy(column).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    folds = cells.groupBy(fold).agg(F.sum("s").alias("fold_s"), F.sum("n").alias("fold_n"))
    total = folds.agg(F.sum("fold_s").alias("s"), F.sum("fold_n").alias("n")).first()  # of a row a fold
    priors = folds.select(fold, F.try_divide(F.lit(total.s) - F.col("fold_s"), F.lit(total.n) - F.col("fold_n")).alias("prior"))
    joined = attach(attach(cells, whole, [column], null_is_key=True), priors, [fold], null_is_key=True)
    others = joined.select(column, fold, (F.col("all_s") - F.col("s")).alias("s"), (F.col("all_n") - F.col("n")).alias("n"), "prior")
    table = others.select(column, fold, F.coalesce(blend(F.col("s"), F.col("n"), F.col("prior"), middle, span), "prior").alias(f"{column}_target"))
    return attach(df, table, [column, fold], null_is_key=True)


def ordinal(train: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``<column>_code``: the place of a category in the training rows' sorted ones, -1 if unknown or missing."""
    values = train.where(F.col(column).isNotNull()).select(column).distinct()
    table = values.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias(f"{column}_code"))
    return attach(df, table, [column]).withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(-1)))


def one_hot(train: DataFrame, df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """``df`` with a 0/1 column for each of the training rows' categories; unknown ones have none set."""
    values = [r[0] for r in train.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return df.select("*", *[F.coalesce(F.col(column) == v, F.lit(False)).cast("double").alias(f"{column}_{v}") for v in values])


def label_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """``df`` with ``<column>_code``: categories numbered in the order in which they first appear."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("__first"))
    table = firsts.select(column, (F.row_number().over(Window.orderBy("__first")) - 1).alias(f"{column}_code"))
    return attach(df, table, [column])

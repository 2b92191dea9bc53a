"""Evolutionary feature search: the loop runs on the driver, all data work in DataFrames.

Each generation draws parents by weight, proposes operations on them, makes all
candidates in one projection, screens them with one aggregation (correlation
with the target, variance), and tries the best one at a time by
cross-validation, keeping what gains enough.
"""

from __future__ import annotations

import math
import random
import time
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.functions.numeric import correlation, finite
from loomtab.operators.folds import kfold
from loomtab.operators.metrics import SCORERS, Scorer
from loomtab.operators.models import cross_validate
from loomtab.plans.catalog import CAT, ENCODERS, NUM, Catalog, Feature

# The modes' settings.
PRESETS = {
    "lite": {"generations": 12, "parents": 15, "children": 90, "stop_children": 50, "stop_generations": 5, "min_gain": 0.003, "seconds": 300, "cv": 4},
    "medium": {"generations": 25, "parents": 25, "children": 150, "stop_children": 60, "stop_generations": 6, "min_gain": 0.002, "seconds": 900, "cv": 4},
    "best": {"generations": 45, "parents": 40, "children": 240, "stop_children": 80, "stop_generations": 8, "min_gain": 0.0015, "seconds": 3600, "cv": 5},
    "extreme": {"generations": 80, "parents": 60, "children": 360, "stop_children": 120, "stop_generations": 12, "min_gain": 0.001, "seconds": 14400, "cv": 5},
}


class Stagnation(IntEnum):
    NONE, MILD, MODERATE, SEVERE, CRITICAL = range(5)


#: Generations without a new feature, generations without improvement, search intensity, share of the least gain still asked.
LEVELS = {Stagnation.CRITICAL: (8, 12, 1.5, 0.1), Stagnation.SEVERE: (4, 6, 1.0, 0.25), Stagnation.MODERATE: (2, 4, 0.6, 0.5), Stagnation.MILD: (1, 2, 0.3, 0.75), Stagnation.NONE: (0, 0, 0.0, 1.0)}


@dataclass
class Progress:
    """How long a search has been without success."""

    level: Stagnation = Stagnation.NONE
    without_features: int = 0
    without_gain: int = 0
    successes: int = 0

    def record(self, added: bool, improved: bool) -> Stagnation:
        """Rises at once, falls a level after two successes in a row."""
        self.without_features = 0 if added else self.without_features + 1
        self.without_gain = 0 if improved else self.without_gain + 1
        self.successes = self.successes + 1 if added and improved else 0
        reached = next(level for level, (f, i, _, _) in LEVELS.items() if self.without_features >= f > 0 or self.without_gain >= i > 0 or level == Stagnation.NONE)
        if reached > self.level:
            self.level = reached
        elif self.successes >= 2 and self.level > reached:
            self.level = Stagnation(self.level - 1)
            self.successes = 0
        return self.level

    @property
    def intensity(self) -> float:
        return LEVELS[self.level][2]

    @property
    def gain_factor(self) -> float:
        return LEVELS[self.level][3]


@dataclass
class OperationStats:
    """How often an operation has paid, later tries counting more."""

    rate: float = 0.5
    gain: float = 0.0
    fails: int = 0

    def record(self, gain: float, paid: bool) -> None:
        self.rate = 0.9 * self.rate + 0.1 * paid
        if paid:
            self.gain = 0.9 * self.gain + 0.1 * gain
        self.fails = 0 if paid else self.fails + 1

    @property
    def priority(self) -> float:
        """Less by a tenth for each failure in a row, by half at most."""
        return (0.7 * self.rate + 0.3 * min(1.0, 10 * self.gain)) * (1 - min(0.5, 0.1 * self.fails))


def temperature(p: float, intensity: float) -> float:
    """Of the draws, at share ``p`` of the generations."""
    return max(0.1, 0.1 + 0.9 * (1 + math.cos(math.pi * p)) / 2) * (1 + 3 * intensity)


def draw(items: list, weights: list[float], n: int, tau: float, rng: random.Random) -> list:
    """With replacement, by softmax of weight over temperature; all if there are no more than n."""
    if n >= len(items):
        return list(items)
    top = max(weights)
    return rng.choices(items, [math.exp((w - top) / tau) for w in weights], k=n)


@dataclass
class FeatureSearch:
    """Settings and state of a search; ``fit_transform`` gives the frame with what was found, ``catalog`` makes it anew."""

    label: str
    scorer: Scorer = field(default_factory=lambda: SCORERS["rmse"])
    mode: str | None = None
    generations: int = 15
    parents: int = 40
    children: int = 200
    min_gain: float = 0.001
    max_new: int | float | None = None
    stop_children: int = 60
    stop_generations: int = 6
    seconds: float | None = None
    model: object = None
    fold: str = "fold"
    cv: int = 5
    key: str = "row_id"
    seed: int = 42
    leave: tuple[str, ...] = ()
    catalog: Catalog | None = None
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        for name, value in PRESETS.get(self.mode or "", {}).items():
            setattr(self, name, value)

    def search(self, df: DataFrame) -> Catalog:
        """A fitted catalog of the columns and the features that improved the cross-validated score.

        Encoders are fitted anew on each fold's training rows, so no row's own
        label helps to predict it.  A frame without the fold column is dealt
        into ``cv`` folds by its key.
        """
        if self.fold not in df.columns:
            df = kfold(df, self.cv, self.key, self.seed).withColumnRenamed("fold", self.fold)
        rng, began = random.Random(self.seed), time.time()
        base = Catalog.of(df, self.label, (self.fold, *self.leave))
        columns = list(base.features)
        kept: list[Feature] = []
        budget = math.inf if self.max_new is None else int(self.max_new * len(columns)) if isinstance(self.max_new, float) else self.max_new
        stats: dict[str, OperationStats] = {}
        weights = dict.fromkeys(columns, 1.0)
        progress, blacklist = Progress(), set()
        numbers = lambda c: [f.name for f in c.features.values() if f.dtype == NUM]

        def score(catalog: Catalog) -> float:
            if not any(f.op in ENCODERS for f in catalog.features.values()):
                return cross_validate(catalog.transform(df), numbers(catalog), self.label, self.model, self.scorer, self.fold)["mean"]

            def prepare(train: DataFrame, val: DataFrame) -> tuple[DataFrame, DataFrame]:
                fitted = catalog.fit(train)
                return fitted.transform(train), fitted.transform(val)

            return cross_validate(df, numbers(catalog), self.label, self.model, self.scorer, self.fold, prepare)["mean"]

        best = score(base)
        self.history = [{"generation": 0, "score": best, "added": []}]
        for generation in range(1, self.generations + 1):
            if len(kept) >= budget or self.seconds and time.time() - began > self.seconds or progress.without_gain >= self.stop_generations:
                break
            tau = temperature(generation / self.generations, progress.intensity)
            pool = list(base.features.values())
            chosen = draw(pool, [weights.get(f.name, 1.0) for f in pool], self.parents, tau, rng)
            candidates = self._candidates(base, chosen, stats, blacklist, rng)
            ranked = self._screen(df, base, candidates)
            added, missed = [], 0
            for op, left, right, worth in ranked:
                if len(kept) >= budget or missed >= self.stop_children or self.seconds and time.time() - began > self.seconds:
                    break
                trial = Catalog(list(base.features.values()), base.registry, self.label)
                made = trial.add(op, left, right)
                value = score(trial)
                gain = ((value - best) if self.scorer.greater_is_better else (best - value)) / (abs(best) + 1e-8)
                paid = gain >= self.min_gain * progress.gain_factor
                stats.setdefault(op, OperationStats()).record(gain, paid)
                if paid:
                    base, best, missed = trial, value, 0
                    kept.append(made)
                    added.append(made.name)
                    weights[made.name] = 1.0 + worth
                else:
                    missed += 1
                    blacklist.add(base.name(op, left, right))
            progress.record(bool(added), bool(added))
            self.history.append({"generation": generation, "score": best, "added": added})
        self.catalog = base.fit(df)
        return self.catalog

    def _candidates(self, base: Catalog, parents: list[Feature], stats: dict[str, OperationStats], blacklist: set[str], rng: random.Random) -> list[tuple[str, str, str | None]]:
        out: dict[str, tuple[str, str, str | None]] = {}
        for _ in range(10 * self.children):
            if len(out) >= self.children:
                break
            a, b = rng.choice(parents), rng.choice(parents)
            if a.dtype == CAT and b.dtype == NUM:
                b = None
            elif a.dtype == NUM and (b.dtype == CAT or a.name == b.name):
                b = None
            elif a.name == b.name:
                b = None
            ops = list(ENCODERS if a.dtype == CAT else base.registry.unary[NUM]) if b is None else list(base.registry.binary[a.dtype])
            op = rng.choices(ops, [0.1 + stats[o].priority if o in stats else 0.6 for o in ops])[0]
            name = base.name(op, a.name, b.name if b else None)
            if name not in base.features and name not in blacklist:
                out[name] = (op, a.name, b.name if b else None)
        return list(out.values())

    def _screen(self, df: DataFrame, base: Catalog, candidates: list[tuple[str, str, str | None]]) -> list[tuple[str, str, str | None, float]]:
        """Candidates by size of correlation with the target, those without variance left out; one pass for all."""
        trial = Catalog(list(base.features.values()), base.registry, self.label)
        named = {trial.add(*c).name: c for c in candidates}
        made = trial.fit(df).transform(df)
        numbers = [n for n in named if trial.features[n].dtype == NUM]
        if not numbers:
            return []
        y = F.col(self.label).cast("double")
        row = made.agg(*[correlation(finite(F.col(f"`{n}`")), y).alias(f"c{i}") for i, n in enumerate(numbers)], *[F.var_pop(finite(F.col(f"`{n}`"))).alias(f"v{i}") for i, n in enumerate(numbers)]).first()
        worth = {n: abs(row[f"c{i}"] or 0.0) for i, n in enumerate(numbers) if (row[f"v{i}"] or 0.0) > 1e-10 and not math.isnan(row[f"c{i}"] or 0.0)}
        return [(*named[n], w) for n, w in sorted(worth.items(), key=lambda x: (-x[1], x[0]))]

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.search(df).transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.catalog is None:
            raise ValueError("search first")
        return self.catalog.transform(df)

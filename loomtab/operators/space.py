"""Hyper-parameter spaces for ``pyspark.ml`` trees and linear models, scaled to a dataset's profile and a budget."""

from __future__ import annotations

import math

# The templates' ranges; a third entry marks a logarithmic one.
TEMPLATES = {
    "gbt": {"maxIter": (20, 200), "maxDepth": (2, 8), "stepSize": (0.02, 0.3, True), "subsamplingRate": (0.6, 1.0), "minInstancesPerNode": (1, 50, True)},
    "forest": {"numTrees": (30, 300), "maxDepth": (4, 12), "subsamplingRate": (0.5, 1.0), "minInstancesPerNode": (1, 50, True), "featureSubsetStrategy": ["sqrt", "onethird", "all"]},
    "linear": {"regParam": (1e-6, 1.0, True), "elasticNetParam": (0.0, 1.0), "maxIter": (50, 300)},
}
BUDGETS = {"low": 0.5, "medium": 1.0, "high": 1.6}


def cost_factor(n: int, p: int, score: float) -> float:
    return max(1.0, math.log10(max(n, 1))) ** 1.5 * max(1.0, math.log10(max(p, 1))) ** 1.1 * max(1.0, score**1.2)


def time_level(seconds: float, n: int, p: int, score: float, unit: float = 0.5) -> tuple[str, float]:
    """Budget level and scale that a time allows."""
    ratio = seconds / (cost_factor(n, p, score) * unit) / 1000
    if ratio < 0.0005:
        level, scale = "low", 0.5 + 0.3 * ratio / 0.0005
    elif ratio < 0.005:
        level, scale = "medium", 0.8 + 0.4 * (ratio - 0.0005) / 0.0045
    else:
        level, scale = "high", 1.2 + 1.3 * (1 - math.exp(-0.5 * ratio / 0.005))
    return level, min(2.5, max(0.5, scale))


def space(model: str, n: int, p: int, budget: str = "medium", imbalance: float = 1.0) -> dict:
    """Ranges (low, high[, True]), or lists of choices, for a model on n rows and p features."""
    s, f = math.log10(max(n, 10) / 1e4), BUDGETS[budget]
    clip = lambda x, lo, hi: max(lo, min(hi, x))
    out: dict = {}
    for name, held in TEMPLATES[model].items():
        if isinstance(held, list):
            out[name] = held
            continue
        low, high, *log = held
        if name in ("maxIter", "numTrees") and model != "linear":
            low, high = low * (1 + clip(0.5 * s, -0.3, 0.6)), high * (1 + clip(s, -0.5, 1.2)) * f
        elif name == "maxDepth":
            high *= 1 + clip(0.5 * s, -0.4, 0.6)
        elif name == "minInstancesPerNode":
            high *= 1 + clip(0.8 * s, -0.3, 1.2)
        elif name == "regParam":
            high *= 1 + max(0.0, math.log10(max(p, 1) / 150))
        whole = isinstance(held[0], int)
        low, high = (int(low), max(int(low) + 1, int(high))) if whole else (low, high)
        out[name] = (low, high, *log)
    if imbalance >= 3:
        out["weightCol"] = ["balance"]
    return out

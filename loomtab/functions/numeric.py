"""Numeric feature functions as Column expressions.

Inputs are cast to double and NaN counts as missing.  A guard that fails gives
null, so no expression here yields NaN or an infinity, or raises under ANSI
mode.  ``UNARY`` and ``BINARY`` hold the first operator set, ``UNARY2`` and
``BINARY2`` the second, whose guards differ under the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The guards' bounds.
TINY, HUGE, SQUARE_LIMIT, EXP_LIMIT, TAN_LIMIT, POW_EXPONENT, POW_BASE = 1e-15, 1e15, 1e7, 50.0, 1e10, 10.0, 1e10
OFFSET = 1e-8


def number(c: Column) -> Column:
    """A column as a double without NaN."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def _if(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _bounded_ratio(a: Column, b: Column) -> Column:
    ratio = _divide(a, b)
    return _if((F.abs(b) > TINY) & (F.abs(ratio) < HUGE), ratio)


def _clipped(a: Column) -> Column:
    return _if(a.isNotNull(), F.greatest(F.least(a, F.lit(1.0)), F.lit(-1.0)))


def _sigmoid(a: Column) -> Column:
    # a missing input falls through both tests
    return F.when(F.abs(a) <= EXP_LIMIT, 1 / (1 + F.exp(-a))).when(a > EXP_LIMIT, 1.0).otherwise(0.0)


def _power(a: Column, b: Column) -> Column:
    whole = F.abs(b - F.rint(b)) < 1e-10
    allowed = (F.abs(b) < POW_EXPONENT) & (F.abs(a) < POW_BASE) & ((a >= 0) | whole) & ~((a == 0) & (b < 0))
    value = F.pow(a, F.when(a < 0, F.rint(b)).otherwise(b))
    return _if(allowed & (F.abs(value) < HUGE), value)


def _both(a: Column, b: Column, value: Column) -> Column:
    return _if(a.isNotNull() & b.isNotNull(), value)


def _relative(a: Column, b: Column) -> Column:
    return _if(F.abs(b) > TINY, _divide(a - b, F.abs(b)))


def _modulo(a: Column, b: Column) -> Column:
    # the result takes the sign of b
    return _if(F.abs(b) > TINY, a - b * F.floor(_divide(a, b)).cast("double"))


UNARY: dict[str, Callable[[Column], Column]] = {
    "neg": lambda a: -a,
    "abs": F.abs,
    "square": lambda a: _if(F.abs(a) < SQUARE_LIMIT, a * a),
    "cube": lambda a: _if(F.abs(a) < SQUARE_LIMIT, a * a * a),
    "sqrt": lambda a: _if(a >= 0, F.sqrt(a)),
    "log": lambda a: _if(a > 0, F.ln(a)),
    "exp": lambda a: _if(F.abs(a) <= EXP_LIMIT, F.exp(a)),
    "inv": lambda a: _bounded_ratio(F.lit(1.0), a),
    "sin": F.sin,
    "cos": F.cos,
    "tan": lambda a: _if(F.abs(F.tan(a)) < TAN_LIMIT, F.tan(a)),
    "sigmoid": _sigmoid,
    "tanh": F.tanh,
    "reciprocal_sqrt": lambda a: _if((a > TINY) & (a < HUGE), 1 / F.sqrt(a)),
    "log10": lambda a: _if(a > 0, F.log10(a)),
    "log2": lambda a: _if(a > 0, F.log2(a)),
    "cbrt": F.cbrt,
    "floor": lambda a: F.floor(a).cast("double"),
    "ceil": lambda a: F.ceil(a).cast("double"),
    "round": F.rint,
    "sign": F.signum,
    "arcsin": lambda a: F.asin(_clipped(a)),
    "arccos": lambda a: F.acos(_clipped(a)),
    "arctan": F.atan,
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "absdiff": lambda a, b: F.abs(a - b),
    "diff_ratio": lambda a, b: _if(a + b != 0, (a - b) / (F.abs(a + b) + TINY)),
    "mul": lambda a, b: _if(F.abs(a * b) < HUGE, a * b),
    "div": _bounded_ratio,
    "logmul": lambda a, b: _if((a > 0) & (b > 0) & (a * b < HUGE), F.ln(1 + F.abs(a * b))),
    "pow": _power,
    "mod": _modulo,
    "max": lambda a, b: _both(a, b, F.greatest(a, b)),
    "min": lambda a, b: _both(a, b, F.least(a, b)),
    "mean": lambda a, b: (a + b) / 2,
    "geometric_mean": lambda a, b: _if((a > 0) & (b > 0), F.sqrt(a * b)),
    "harmonic_mean": lambda a, b: _if((a > 0) & (b > 0), _divide(F.lit(2.0), _divide(F.lit(1.0), a) + _divide(F.lit(1.0), b))),
    "relative_diff": _relative,
    "percent_change": lambda a, b: 100 * _relative(a, b),
    "ratio": _bounded_ratio,
    "distance_euclidean": lambda a, b: F.sqrt((a - b) * (a - b)),
    "distance_manhattan": lambda a, b: F.abs(a - b),
    "angle_between": lambda a, b: F.atan2(b, a),
    "weighted_sum": lambda a, b: 0.7 * a + 0.3 * b,
    "weighted_diff": lambda a, b: 0.7 * a - 0.3 * b,
}

COMMUTATIVE = {"add", "absdiff", "mul", "logmul", "max", "min", "mean", "geometric_mean", "harmonic_mean", "distance_euclidean", "distance_manhattan"}


def _yeo_johnson(a: Column) -> Column:
    """The transform with its parameter fixed at one half."""
    return F.when(a >= 0, (F.pow(F.abs(a) + 1, F.lit(0.5)) - 1) / 0.5).otherwise(-(F.pow(-a + 1, F.lit(1.5)) - 1) / 1.5)


def _capped_power(a: Column, b: Column) -> Column:
    exponent = F.greatest(F.least(b, F.lit(POW_EXPONENT)), F.lit(-POW_EXPONENT))
    base = F.least(F.abs(a), F.lit(1e5))
    odd = F.abs(F.rint(exponent) % 2) == 1
    value = F.when((base == 0) & (exponent < 0), None).otherwise(F.pow(base, exponent))
    signed = F.when((a < 0) & odd, -value).otherwise(value)
    return _both(a, b, _if(F.abs(value) < HUGE, signed))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


UNARY2: dict[str, Callable[[Column], Column]] = {
    **{k: UNARY[k] for k in ("abs", "sign", "neg", "sin", "cos", "arctan", "tanh", "cbrt", "floor", "ceil", "round", "exp", "tan", "arcsin", "arccos", "sigmoid")},
    "log": lambda a: F.ln(F.abs(a) + OFFSET),
    "log10": lambda a: F.log10(F.abs(a) + OFFSET),
    "log2": lambda a: F.log2(F.abs(a) + OFFSET),
    "sqrt": lambda a: F.sqrt(F.abs(a)),
    "square": lambda a: a * a,
    "cube": lambda a: a * a * a,
    "inverse": lambda a: _divide(F.lit(1.0), a + OFFSET),
    "yeo_johnson": _yeo_johnson,
    "log1p": lambda a: F.ln(1 + F.abs(a)),
    "power_2": lambda a: F.signum(a) * F.sqrt(F.abs(a)),
    "power_3": lambda a: F.signum(a) * F.cbrt(F.abs(a)),
}

BINARY2: dict[str, Callable[[Column, Column], Column]] = {
    "subtract": BINARY["sub"],
    "multiply": BINARY["mul"],
    "divide": BINARY["div"],
    "modulo": BINARY["mod"],
    **{k: BINARY[k] for k in ("add", "max", "min", "mean", "geometric_mean", "relative_diff", "percent_change", "diff_ratio", "weighted_diff")},
    "power": _capped_power,
    "harmonic_mean": lambda a, b: _divide(F.lit(2.0), _divide(F.lit(1.0), a + OFFSET) + _divide(F.lit(1.0), b + OFFSET)),
    "euclidean": lambda a, b: F.abs(a - b),
    "manhattan": lambda a, b: F.abs(a - b),
    "greater": lambda a, b: _flag(a > b),
    "less": lambda a, b: _flag(a < b),
    "equal": lambda a, b: _flag(F.abs(a - b) < 1e-6),
    "not_equal": lambda a, b: _flag(F.abs(a - b) >= 1e-6),
    "weighted_sum_07_03": BINARY["weighted_sum"],
    "weighted_sum_06_04": lambda a, b: 0.6 * a + 0.4 * b,
}


def finite(c: Column) -> Column:
    """Infinities and missing values as 0, for models that accept neither."""
    d = number(c)
    return F.when(F.abs(d) < float("inf"), d).otherwise(0.0)


def bounded(c: Column, limit: float = 1e9) -> Column:
    """Infinities as plus or minus ``limit``, missing values as 0."""
    d = number(c)
    return F.coalesce(F.when(F.abs(d) == float("inf"), F.signum(d) * limit).otherwise(d), F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    """A value held within bounds; missing stays missing."""
    return _if(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation as an aggregate, over rows where both are there; null where one doesn't vary, which the built-in raises on under ANSI mode."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

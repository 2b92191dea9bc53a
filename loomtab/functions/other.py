"""String and calendar feature functions as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as missing in text columns.
SENTINELS = ("-", "", " ", "NaN", "nan", "Nan", "NAN", "Unknown", "unknown")
#: Periods of the cyclic calendar columns.
PERIODS = {"hour": 24, "month": 12, "day_of_week": 7, "day_of_year": 365}


def concat(a: Column, b: Column) -> Column:
    """Both values joined by an underscore, a missing one as ``nan``."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("nan"))
    return F.concat_ws("_", text(a), text(b))


def match(a: Column, b: Column) -> Column:
    """1 where two categories are equal; missing equals nothing."""
    return F.coalesce(a == b, F.lit(False)).cast("double")


def mismatch(a: Column, b: Column) -> Column:
    return 1 - match(a, b)


def missing(c: Column) -> Column:
    """A text column with its sentinels as null."""
    return F.when(~c.isin(*SENTINELS), c)


def plain_number(c: Column) -> Column:
    return c.try_cast("double")


def grouped_number(c: Column) -> Column:
    """A number with comma thousands."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def percentage(c: Column) -> Column:
    """A percentage as a share."""
    return F.regexp_replace(c, r"[\s%]", "").try_cast("double") / 100


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a calendar value on its circle."""
    angle = c * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def synthetic_timestamp(day_of_year: Column, hour: Column, year: int = 2023) -> Column:
    """A timestamp of a day of the year and an hour; a day that the year lacks is null."""
    day = F.date_add(F.make_date(F.lit(year), F.lit(1), F.lit(1)), (day_of_year - 1).cast("int"))
    inside = (day_of_year >= 1) & (F.year(day) == year)
    return F.when(inside, F.timestamp_add("HOUR", hour.cast("int"), day.cast("timestamp_ntz")))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


DATE_UNARY: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "dayofweek": F.weekday,
    "dayofyear": F.dayofyear,
    "quarter": F.quarter,
    "is_weekend": lambda t: F.weekday(t) >= 5,
    "is_month_end": lambda t: F.to_date(t) == F.last_day(t),
    "is_month_start": lambda t: F.dayofmonth(t) == 1,
    "week_of_year": F.weekofyear,
}

DATE_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "days_diff": lambda a, b: F.floor((_micros(a) - _micros(b)) / 86_400_000_000),
    "years_diff": lambda a, b: F.floor((_micros(a) - _micros(b)) / 86_400_000_000) / 365.25,
    "hours_diff": lambda a, b: (_micros(a) - _micros(b)) / 3_600_000_000,
}

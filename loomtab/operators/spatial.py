"""Spatio-temporal features: calendar and coordinate blocks as one projection, neighbours and clusters as joins.

Neighbours are searched in a grid that starts fine and doubles its width for
the rows that have too few, so no row meets all others; places are counted
once however many rows share them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions.other import PERIODS, cyclic
from loomtab.operators.tables import attach

#: Rows in the fullest cell of the first grid, about.
FULL = 64


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def block(df: DataFrame) -> DataFrame:
    """``df`` with cyclic, interaction, calendar, season and coordinate features."""
    lat, lon, hour, month, dow, doy = (F.col(c) for c in ("latitude", "longitude", "hour", "month", "day_of_week", "day_of_year"))
    weekday = dow < 5
    month_sin = cyclic(month, PERIODS["month"])[0]
    made = {
        **{f"{c}_{n}": v for c, p in PERIODS.items() for n, v in zip(("sin", "cos"), cyclic(F.col(c), p))},
        "hour_month_interaction": hour * month, "hour_dow_interaction": hour * dow, "month_dow_interaction": month * dow,
        "is_weekend": _flag(~weekday), "is_weekday": _flag(weekday), "is_rush_hour": _flag(hour.isin(7, 8, 9, 17, 18, 19)), "is_night": _flag((hour >= 22) | (hour <= 5)), "is_business_hours": _flag(hour.between(9, 17) & weekday),
        "season": F.floor((month - 1) / 3).cast("int"), "is_summer": _flag(month.isin(6, 7, 8)), "is_winter": _flag(month.isin(12, 1, 2)), "quarter": F.floor((month - 1) / 3).cast("int") + 1, "week_of_year": F.floor((doy - 1) / 7).cast("int") + 1,
        "lat_lon_interaction": lat * lon, "distance_from_equator": F.abs(lat), "distance_from_prime_meridian": F.abs(lon), "lat_squared": lat * lat, "lon_squared": lon * lon, "lat_cubed": lat * lat * lat, "lon_cubed": lon * lon * lon,
        "northern_hemisphere": _flag(lat > 0), "eastern_hemisphere": _flag(lon > 0), "spatial_temporal_interaction": F.abs(lat) * month_sin, "lat_hour_interaction": lat * hour, "lon_hour_interaction": lon * hour, "lat_month_interaction": lat * month, "lon_month_interaction": lon * month,
    }
    return df.select("*", *[v.alias(k) for k, v in made.items()])


def winter(df: DataFrame) -> DataFrame:
    """``df`` with features that join December to January and follow the cold."""
    lat, hour, month, dow, doy = (F.col(c) for c in ("latitude", "hour", "month", "day_of_week", "day_of_year"))
    cold, january, north, weekday = _flag(month.isin(12, 1, 2)), _flag(month == 1), _flag(lat > 0), _flag(dow < 5)
    night = _flag((hour >= 22) | (hour <= 5))
    proxy = F.when(lat.isNotNull(), january * F.greatest(lat - 30, F.lit(0.0)) / 60)
    heating = _flag(hour.isin(6, 7, 8, 17, 18, 19, 20))
    day = F.when(doy >= 335, doy - 335).when(doy <= 31, doy + 30)
    made = {
        "dec_jan_bridge": _flag(month.isin(12, 1)), "dec_jan_transition": F.when(month == 12, 1).when(month == 1, -1).otherwise(0), "winter_depth": F.when(month == 1, 1.0).when(month.isin(12, 2), 0.7).otherwise(0.0), "days_from_jan_1": F.least(doy - 1, 365 - doy + 1),
        "winter_northern_hemisphere": cold * north, "winter_latitude_intensity": cold * F.abs(lat), "winter_high_latitude": cold * _flag(lat > 45), "winter_heating_hours": cold * heating, "winter_business_hours": cold * _flag(hour.between(9, 17)) * weekday,
        "winter_weekend": cold * (1 - weekday), "winter_night": cold * night, "jan_morning_rush": january * _flag(hour.between(7, 9)), "jan_evening_rush": january * _flag(hour.between(17, 19)), "jan_midday": january * _flag(hour.between(11, 13)), "jan_early_morning": january * _flag(hour.between(0, 5)),
        "winter_monday": cold * _flag(dow == 0), "winter_friday": cold * _flag(dow == 4), "winter_workday_pattern": cold * weekday, "seasonal_boundary": F.cos((doy - 1) * (2 * math.pi / 365)), "winter_solstice_distance": F.abs(doy - 355), "year_end_proximity": F.least(F.abs(doy - 365), F.abs(doy - 1)),
        "jan_cold_proxy": proxy, "jan_heating_demand": proxy * heating, "jan_evening_heating": proxy * _flag(hour.between(17, 20)), "winter_month_continuous": F.when(month == 1, 12 + (doy - 1) / 365).otherwise(month.cast("double")),
        "winter_day_sin": F.coalesce(F.sin(day * (2 * math.pi / 62)), F.lit(0.0)), "winter_day_cos": F.coalesce(F.cos(day * (2 * math.pi / 62)), F.lit(0.0)), "jan_inversion_risk": january * _flag(lat > 40), "jan_urban_heating": january * heating * weekday, "jan_weekend_heating": january * heating * (1 - weekday),
    }
    return df.select("*", *[v.alias(k) for k, v in made.items()])


def polynomials(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``df`` with sums, products and powers of the coordinates, missing ones filled by the median."""
    m = df.agg(F.median(lat).alias("a"), F.median(lon).alias("b")).first()
    a, b = F.coalesce(lat, F.lit(m.a or 0.0)), F.coalesce(lon, F.lit(m.b or 0.0))
    made = {"coord_sum": a + b, "coord_diff": a - b, "coord_product": a * b, "coord_ratio": F.try_divide(a, b + 1e-5), "lat_sq": a * a, "lon_sq": b * b, "lat_cu": a * a * a, "lon_cu": b * b * b, "radius": F.sqrt(a * a + b * b)}
    return df.select("*", *[v.alias(k) for k, v in made.items()])


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle between two places in radians."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.sin((q - p) / 2) ** 2 + F.cos(p) * F.cos(q) * F.sin((F.radians(lon2) - F.radians(lon1)) / 2) ** 2
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def unit_vector(lat: str, lon: str) -> list[Column]:
    """A place on the unit sphere; chords there order places as angles do."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _gap(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) ** 2))


def _around(cells: list[Column]) -> Column:
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    out = F.transform(steps, lambda s: F.array(cells[0] + s))
    for c in cells[1:]:
        out = F.flatten(_cross(out, c, steps))
    return out


def _cross(out: Column, c: Column, steps: Column) -> Column:
    return F.transform(out, lambda k: F.transform(steps, lambda s: F.concat(k, F.array(c + s))))


def within(queries: DataFrame, places: DataFrame, at: list[Column], to: list[Column], radius: float, key: str, by: list[str] | None = None) -> DataFrame:
    """(key, distance, n): places within ``radius`` of each query and how many rows share them; ``by`` must agree.

    Both sides are cut into cells as wide as the radius, and a query looks into its own and all around.
    """
    by = by or []
    d = len(at)
    cells = lambda xs: [F.floor(x / radius) for x in xs]
    p = places.select(*by, *[x.alias(f"__p{i}") for i, x in enumerate(to)]).dropna().groupBy(*by, *[f"__p{i}" for i in range(d)]).agg(F.count(F.lit(1)).alias("n"))
    p = p.select("*", F.array(*cells([F.col(f"__p{i}") for i in range(d)])).alias("__cell"))
    q = queries.select(F.col(key), *by, *[x.alias(f"__q{i}") for i, x in enumerate(at)]).dropna()
    q = q.select("*", F.explode(_around(cells([F.col(f"__q{i}") for i in range(d)]))).alias("__cell"))
    gap = _gap([F.col(f"__q{i}") for i in range(d)], [F.col(f"__p{i}") for i in range(d)])
    return q.join(p, ["__cell", *by]).select(key, gap.alias("distance"), "n").where(F.col("distance") <= radius)


def nearest(queries: DataFrame, places: DataFrame, at: list[Column], to: list[Column], k: int, key: str, start: float, most: float, by: list[str] | None = None) -> DataFrame:
    """(key, distances): each query's distances to its k nearest places, ascending, rows that share a place counting each.

    The radius starts at ``start`` and doubles, up to ``most``, for queries that have fewer than k within it; those with fewer than k in all get what there is.
    """
    done, radius, left = None, start, queries
    while True:
        # a place's rows beyond the k-th cannot matter
        repeated = F.flatten(F.collect_list(F.array_repeat("distance", F.least("n", F.lit(k)).cast("int"))))
        found = within(left, places, at, to, radius, key, by).groupBy(key).agg(F.slice(F.array_sort(repeated), 1, k).alias("distances"))
        last = radius >= most
        full = found if last else found.where(F.size("distances") >= k)
        done = full if done is None else done.unionByName(full)
        if last:
            return done
        left = left.join(full.select(key), key, "left_anti")
        if left.limit(1).count() == 0:
            return done
        # else each round's plan would hold the one before twice
        left = left.checkpoint() if left.sparkSession.sparkContext.getCheckpointDir() else left.localCheckpoint()
        radius *= 2


def density(queries: DataFrame, places: DataFrame, at: list[Column], to: list[Column], radii: list[float], key: str) -> DataFrame:
    """(key, density_r0, density_r1, ...): rows within each radius; none is 0."""
    near = within(queries, places, at, to, max(radii), key).groupBy(key).agg(*[F.sum(F.when(F.col("distance") <= r, F.col("n")).otherwise(0)).alias(f"density_r{i}") for i, r in enumerate(radii)])
    return queries.select(key).join(near, key, "left").na.fill(0)


def centroid_distances(df: DataFrame, centroids: list[tuple[float, ...]], columns: list[str]) -> DataFrame:
    """``df`` with distances to a few fixed centroids: the nearest three and their numbers, least and mean."""
    gaps = F.array(*[F.struct(_gap([F.col(c) for c in columns], [F.lit(float(v)) for v in m]).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(centroids)])
    known = F.when(sum((F.col(c).isNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNull().cast("int")) == 0, F.array_sort(gaps))
    total = F.aggregate("__g", F.lit(0.0), lambda a, g: a + g.d)
    picks = [x for j in range(min(3, len(centroids))) for x in (F.get("__g", F.lit(j)).i.alias(f"nearest_cluster_{j}"), F.get("__g", F.lit(j)).d.alias(f"dist_to_cluster_{j}"))]
    return df.select("*", known.alias("__g")).select(*df.columns, F.get("__g", F.lit(0)).i.alias("cluster"), F.get("__g", F.lit(0)).d.alias("min_cluster_dist"), (total / len(centroids)).alias("mean_cluster_dist"), *picks)


def group_stats(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """A row a group: mean, population deviation, median, quartiles, population skewness, count."""
    return df.groupBy(*keys).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.median(y).alias("median"), F.percentile(y, F.lit(0.25)).alias("q25"), F.percentile(y, F.lit(0.75)).alias("q75"), F.coalesce(F.skewness(y), F.lit(0.0)).alias("skew"), F.count(y).alias("count"))


def pattern(train: DataFrame, df: DataFrame, keys: list[str], y: str, name: str) -> DataFrame:
    """``df`` with a group's mean and deviation from ``train``; a group not seen there gets the mean over the rows that have one."""
    table = train.groupBy(*keys).agg(F.avg(y).alias(f"{name}_mean"), F.stddev_pop(y).alias(f"{name}_std"))
    out = attach(df, table, keys)
    fill = out.agg(F.avg(f"{name}_mean").alias("m"), F.avg(f"{name}_std").alias("s")).first()
    return out.withColumns({f"{name}_mean": F.coalesce(f"{name}_mean", F.lit(fill.m or 0.0)), f"{name}_std": F.coalesce(f"{name}_std", F.lit(fill.s or 0.0))})


def _first_radius(places: DataFrame, to: list[Column], start: float, k: int) -> float:
    """``start``, halved as often as would leave ``FULL`` rows in the fullest cell, were they spread evenly there; a place's rows beyond the k-th do not count."""
    shared = places.select(*[x.alias(f"__p{i}") for i, x in enumerate(to)]).dropna().groupBy(*[f"__p{i}" for i in range(len(to))]).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    cells = shared.groupBy(*[F.floor(F.col(f"__p{i}") / start) for i in range(len(to))]).agg(F.sum("n").alias("n"))
    fullest = cells.agg(F.max("n")).first()[0] or 1
    return start / 2 ** max(0, math.ceil(math.log(fullest / FULL, 2) / len(to)))


def proximity_weights(train: DataFrame, test: DataFrame, columns: list[str], key: str, k: int = 10, start: float = 16.0, most: float = 512.0) -> DataFrame:
    """(key, weight): one over one plus the mean distance to the k nearest test rows, mean 1."""
    at = [F.col(c) for c in columns]
    rows = train.select(key, *columns).dropna().select(key, F.struct(*columns).alias("__at"))
    # rows that share a place share a weight
    asked = rows.select("__at").distinct().select("__at", "__at.*")
    near = nearest(asked, test, at, at, k, "__at", _first_radius(test, at, start, k), most)
    each = near.select("__at", (1 / (1 + F.aggregate("distances", F.lit(0.0), lambda a, d: a + d) / F.size("distances"))).alias("weight"))
    raw = rows.join(each, "__at").select(key, "weight")
    mean = raw.agg(F.avg("weight")).first()[0] or 1.0
    return raw.select(key, (F.col("weight") / F.lit(mean)).alias("weight"))

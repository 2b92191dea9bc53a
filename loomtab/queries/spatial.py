"""Spatio-temporal features, a query each."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomtab.operators import shift, spatial
from loomtab.queries.base import inline, query, tidy, tidy_sql

_OBS = inline("obs")
_X = f"WITH x AS (SELECT * FROM {_OBS})"
_PI2 = repr(2 * math.pi)
_CENTROIDS = [(-40.0, -120.0), (-20.0, 30.0), (0.0, 100.0), (25.0, -60.0), (50.0, 10.0)]


def _features(build, columns: dict[str, str], source: str = _OBS):
    made = lambda df: build(df).select("row_id", *[tidy(F.col(c)).alias(c) for c in columns])
    return query("obs", made), "SELECT row_id, " + ", ".join(f"{tidy_sql(s)} AS {c}" for c, s in columns.items()) + f" FROM {source}"


def _f(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


_WEEKDAY, _COLD, _JAN, _HEAT = _f("day_of_week < 5"), _f("month IN (12, 1, 2)"), _f("month = 1"), _f("hour IN (6, 7, 8, 17, 18, 19, 20)")
_PROXY = f"(CASE WHEN latitude IS NOT NULL THEN {_JAN} * greatest(latitude - 30, 0) / 60 END)"
_DAY = "(CASE WHEN day_of_year >= 335 THEN day_of_year - 335 WHEN day_of_year <= 31 THEN day_of_year + 30 END)"
_BLOCK = {
    **{f"{c}_{f}": f"{f}({c} * {2 * math.pi / p!r})" for c, p in (("hour", 24), ("month", 12), ("day_of_week", 7), ("day_of_year", 365)) for f in ("sin", "cos")},
    "hour_month_interaction": "hour * month", "hour_dow_interaction": "hour * day_of_week", "month_dow_interaction": "month * day_of_week", "is_weekend": _f("day_of_week >= 5"), "is_weekday": _WEEKDAY, "is_rush_hour": _f("hour IN (7, 8, 9, 17, 18, 19)"),
    "is_night": _f("hour >= 22 OR hour <= 5"), "is_business_hours": _f("hour BETWEEN 9 AND 17 AND day_of_week < 5"), "season": "(month - 1) // 3", "is_summer": _f("month IN (6, 7, 8)"), "is_winter": _COLD, "quarter": "(month - 1) // 3 + 1", "week_of_year": "(day_of_year - 1) // 7 + 1",
    "lat_lon_interaction": "latitude * longitude", "distance_from_equator": "abs(latitude)", "distance_from_prime_meridian": "abs(longitude)", "lat_squared": "latitude * latitude", "lon_squared": "longitude * longitude", "lat_cubed": "latitude * latitude * latitude", "lon_cubed": "longitude * longitude * longitude",
    "northern_hemisphere": _f("latitude > 0"), "eastern_hemisphere": _f("longitude > 0"), "spatial_temporal_interaction": f"abs(latitude) * sin(month * {2 * math.pi / 12!r})", "lat_hour_interaction": "latitude * hour", "lon_hour_interaction": "longitude * hour", "lat_month_interaction": "latitude * month", "lon_month_interaction": "longitude * month",
}
_WINTER = {
    "dec_jan_bridge": _f("month IN (12, 1)"), "dec_jan_transition": "CASE month WHEN 12 THEN 1 WHEN 1 THEN -1 ELSE 0 END", "winter_depth": "CASE WHEN month = 1 THEN 1e0 WHEN month IN (12, 2) THEN 0.7e0 ELSE 0 END", "days_from_jan_1": "least(day_of_year - 1, 366 - day_of_year)",
    "winter_northern_hemisphere": f"{_COLD} * {_f('latitude > 0')}", "winter_latitude_intensity": f"{_COLD} * abs(latitude)", "winter_high_latitude": f"{_COLD} * {_f('latitude > 45')}", "winter_heating_hours": f"{_COLD} * {_HEAT}", "winter_business_hours": f"{_COLD} * {_f('hour BETWEEN 9 AND 17')} * {_WEEKDAY}",
    "winter_weekend": f"{_COLD} * (1 - {_WEEKDAY})", "winter_night": f"{_COLD} * {_f('hour >= 22 OR hour <= 5')}", "jan_morning_rush": f"{_JAN} * {_f('hour BETWEEN 7 AND 9')}", "jan_evening_rush": f"{_JAN} * {_f('hour BETWEEN 17 AND 19')}", "jan_midday": f"{_JAN} * {_f('hour BETWEEN 11 AND 13')}", "jan_early_morning": f"{_JAN} * {_f('hour BETWEEN 0 AND 5')}",
    "winter_monday": f"{_COLD} * {_f('day_of_week = 0')}", "winter_friday": f"{_COLD} * {_f('day_of_week = 4')}", "winter_workday_pattern": f"{_COLD} * {_WEEKDAY}", "seasonal_boundary": f"cos((day_of_year - 1) * {2 * math.pi / 365!r})", "winter_solstice_distance": "abs(day_of_year - 355)", "year_end_proximity": "least(abs(day_of_year - 365), abs(day_of_year - 1))",
    "jan_cold_proxy": _PROXY, "jan_heating_demand": f"{_PROXY} * {_HEAT}", "jan_evening_heating": f"{_PROXY} * {_f('hour BETWEEN 17 AND 20')}", "winter_month_continuous": "CASE WHEN month = 1 THEN 12 + (day_of_year - 1) / 365 ELSE month END",
    "winter_day_sin": f"coalesce(sin({_DAY} * {2 * math.pi / 62!r}), 0)", "winter_day_cos": f"coalesce(cos({_DAY} * {2 * math.pi / 62!r}), 0)", "jan_inversion_risk": f"{_JAN} * {_f('latitude > 40')}", "jan_urban_heating": f"{_JAN} * {_HEAT} * {_WEEKDAY}", "jan_weekend_heating": f"{_JAN} * {_HEAT} * (1 - {_WEEKDAY})",
}
_A, _B = f"coalesce(latitude, (SELECT median(latitude) FROM {_OBS}))", "longitude"
_POLY = {"coord_sum": f"{_A} + {_B}", "coord_diff": f"{_A} - {_B}", "coord_product": f"{_A} * {_B}", "coord_ratio": f"{_A} / ({_B} + 1e-5)", "lat_sq": f"{_A} * {_A}", "lon_sq": f"{_B} * {_B}", "lat_cu": f"{_A} * {_A} * {_A}", "lon_cu": f"{_B} * {_B} * {_B}", "radius": f"sqrt({_A} * {_A} + {_B} * {_B})"}
_STATS = {"mean": "avg(y)", "std": "stddev_pop(y)", "median": "median(y)", "q25": "quantile_cont(y, 0.25)", "q75": "quantile_cont(y, 0.75)"}


def _chord(df):
    """Every twentieth row against all, by angle."""
    asked = df.where("row_id % 20 = 0")
    to = spatial.unit_vector("latitude", "longitude")
    found = spatial.nearest(asked, df, to, to, 5, "row_id", 0.02, 2.0)
    angle = lambda d: 2 * F.asin(F.least(d / 2, F.lit(1.0)))
    return found.select("row_id", *[tidy(angle(F.get("distances", F.lit(i)))).alias(f"neighbour_{i}") for i in range(5)])


def _by_hour(df):
    to = [F.col("latitude"), F.col("longitude")]
    found = spatial.nearest(df.where("row_id % 20 = 0"), df, to, to, 3, "row_id", 8.0, 512.0, ["hour"])
    return found.select("row_id", *[tidy(F.get("distances", F.lit(i))).alias(f"neighbour_{i}") for i in range(3)])


def _radii(df):
    to = [F.col("latitude"), F.col("longitude")]
    return spatial.density(df.where("row_id % 20 = 0"), df, to, to, [1.0, 5.0, 10.0], "row_id")


_P = f"(SELECT latitude, longitude, hour, cos(radians(latitude)) * cos(radians(longitude)) AS u, cos(radians(latitude)) * sin(radians(longitude)) AS v, sin(radians(latitude)) AS w, row_id FROM {_OBS} WHERE latitude IS NOT NULL)"
_FLAT = "sqrt((a.latitude - b.latitude) * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude))"


def _knn_sql(distance: str, k: int, join: str = "true") -> str:
    picks = ", ".join(f"{tidy_sql(f'max(d) FILTER (r = {i + 1})')} AS neighbour_{i}" for i in range(k))
    return f"SELECT row_id, {picks} FROM (SELECT a.row_id, {distance} AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY {distance}) AS r FROM {_P} a JOIN {_P} b ON {join} WHERE a.row_id % 20 = 0) GROUP BY row_id"


_GAPS = "[" + ", ".join(f"{{'d': sqrt((latitude - {a}) * (latitude - {a}) + (longitude - {b}) * (longitude - {b})), 'i': {i}}}" for i, (a, b) in enumerate(_CENTROIDS)) + "]"

ENTRIES = {
    "st_block": _features(spatial.block, _BLOCK),
    "st_winter_block": _features(spatial.winter, _WINTER),
    "st_coord_poly": _features(spatial.polynomials, _POLY),
    "st_haversine_knn": (query("obs", _chord), _knn_sql("2 * asin(least(sqrt(pow(a.u - b.u, 2) + pow(a.v - b.v, 2) + pow(a.w - b.w, 2)) / 2, 1))", 5)),
    "st_haversine": _features(lambda df: df.withColumn("d", spatial.haversine(F.col("latitude"), F.col("longitude"), F.lit(48.0), F.lit(2.0))), {"d": "2 * asin(sqrt(least(pow(sin((radians(48e0) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(48e0)) * pow(sin((radians(2e0) - radians(longitude)) / 2), 2), 1)))"}),
    "st_hour_knn": (query("obs", _by_hour), _knn_sql(_FLAT, 3, "a.hour = b.hour")),
    "st_radius_count": (query("obs", _radii), f"SELECT a.row_id, " + ", ".join(f"count_if({_FLAT} <= {r})::BIGINT AS density_r{i}" for i, r in enumerate((1, 5, 10))) + f" FROM {_OBS[:-1]}a LEFT JOIN {_P} b ON true WHERE a.row_id % 20 = 0 GROUP BY a.row_id"),
    "st_centroid_distances": (
        query("obs", lambda df: (r := spatial.centroid_distances(df, _CENTROIDS, ["latitude", "longitude"])).select("row_id", *[tidy(F.col(c)).alias(c) for c in r.columns if "clust" in c])),
        f"WITH g AS (SELECT row_id, CASE WHEN latitude IS NOT NULL THEN list_sort({_GAPS}) END AS g FROM {_OBS}) SELECT row_id, {tidy_sql('g[1].i')} AS cluster, {tidy_sql('g[1].d')} AS min_cluster_dist, {tidy_sql('(g[1].d + g[2].d + g[3].d + g[4].d + g[5].d) / 5')} AS mean_cluster_dist, "
        + ", ".join(f"{tidy_sql(f'g[{j + 1}].i')} AS nearest_cluster_{j}, {tidy_sql(f'g[{j + 1}].d')} AS dist_to_cluster_{j}" for j in range(3))
        + " FROM g",
    ),
    "st_cluster_stats": (
        query("obs", lambda df: spatial.group_stats(df, ["month"], "y").select("month", *[tidy(F.col(c)).alias(c) for c in (*_STATS, "skew")], "count")),
        f"SELECT month, {', '.join(f'{tidy_sql(s)} AS {c}' for c, s in _STATS.items())}, {tidy_sql('(avg(y * y * y) - 3 * avg(y) * avg(y * y) + 2 * pow(avg(y), 3)) / pow(var_pop(y), 1.5)')} AS skew, count(y) AS count FROM {_OBS} GROUP BY month",
    ),
    "st_hour_month_pattern": (
        query("obs", lambda df: spatial.pattern(df.where("row_id % 3 <> 0"), df, ["hour", "month"], "y", "hm").select("row_id", tidy(F.col("hm_mean")).alias("hm_mean"), tidy(F.col("hm_std")).alias("hm_std"))),
        f"{_X}, t AS (SELECT hour, month, avg(y) AS m, stddev_pop(y) AS s FROM x WHERE row_id % 3 <> 0 GROUP BY 1, 2), j AS (SELECT row_id, m, s FROM x LEFT JOIN t USING (hour, month)) SELECT row_id, {tidy_sql('coalesce(m, (SELECT avg(m) FROM j))')} AS hm_mean, {tidy_sql('coalesce(s, (SELECT avg(s) FROM j))')} AS hm_std FROM j",
    ),
    "weight_geo_knn": (
        query("obs", lambda df: spatial.proximity_weights(df.where("row_id % 4 <> 0"), df.where("row_id % 4 = 0"), ["latitude", "longitude"], "row_id").select("row_id", tidy(F.col("weight")).alias("weight"))),
        f"WITH n AS (SELECT row_id, 1 / (1 + avg(d)) AS w FROM (SELECT a.row_id, {_FLAT} AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY {_FLAT}) AS r FROM {_P} a JOIN {_P} b ON b.row_id % 4 = 0 WHERE a.row_id % 4 <> 0) WHERE r <= 10 GROUP BY row_id) SELECT row_id, {tidy_sql('w / (SELECT avg(w) FROM n)')} AS weight FROM n",
    ),
    "weight_geo_density": (
        query("obs", lambda df: _density(df).select("row_id", tidy(F.col("weight")).alias("weight"))),
        f"""WITH x AS (SELECT row_id, list_sort({_GAPS})[1].i AS c FROM {_OBS} WHERE latitude IS NOT NULL), a AS (SELECT * FROM x WHERE row_id % 4 <> 0), p AS (SELECT c, count(*) / (SELECT count(*) FROM a) AS s FROM a GROUP BY c), q AS (SELECT c, count(*) AS n FROM x WHERE row_id % 4 = 0 GROUP BY c),
        w AS (SELECT row_id, coalesce(q.n / (SELECT sum(n) FROM q) / p.s, 0.01) AS w FROM a JOIN p USING (c) LEFT JOIN q USING (c)) SELECT row_id, {tidy_sql("w / (SELECT avg(w) FROM w)")} AS weight FROM w""",
    ),
}


def _density(df):
    placed = spatial.centroid_distances(df.where("latitude IS NOT NULL"), _CENTROIDS, ["latitude", "longitude"])
    return shift.temporal_weights(placed.where("row_id % 4 <> 0"), placed.where("row_id % 4 = 0"), ["cluster"])

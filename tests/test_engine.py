"""Behaviour that SQL comparisons don't reach."""

import math

import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from loomtab.functions import numeric, other
from loomtab.operators import encoders, folds, importance, metrics, models, prepare, profile, space, spatial
from loomtab.operators.search import FeatureSearch, Progress, Stagnation
from loomtab.plans.catalog import Catalog
from loomtab.queries import queries
from loomtab.queries.base import frame
from loomtab.sources import readers
from loomtab.streaming import transform

EDGES = [None, float("nan"), 0.0, 1e-16, -1e-16, 0.5, -0.5, 2.5, 1e7, -1e7, 1e10, 60.0, -60.0, 1e16, float("inf"), float("-inf")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in EDGES for b in EDGES)], "row_id long, a double, b double")


@pytest.mark.parametrize("ops", [numeric.UNARY, numeric.UNARY2], ids=["first", "second"])
def test_unary_edges(edges, ops):
    finite = edges.where("NOT (abs(a) = double('Infinity'))")
    made = finite.select(*[f(numeric.number(F.col("a"))).alias(k) for k, f in ops.items()])
    for row in made.distinct().collect():
        assert all(v is None or not math.isnan(v) for v in row)


@pytest.mark.parametrize("ops", [numeric.BINARY, numeric.BINARY2], ids=["first", "second"])
def test_binary_edges(edges, ops):
    finite = edges.where("NOT (abs(a) = double('Infinity')) AND NOT (abs(b) = double('Infinity'))")
    made = finite.select(*[f(numeric.number(F.col("a")), numeric.number(F.col("b"))).alias(k) for k, f in ops.items()])
    for row in made.distinct().collect():
        assert all(v is None or not math.isnan(v) for v in row)


def test_known_values(spark):
    a, b = F.lit(2.5), F.lit(-3.0)
    row = spark.range(1).select(numeric.UNARY["round"](a).alias("r"), numeric.BINARY["mod"](a, b).alias("m"), numeric.UNARY["sigmoid"](F.lit(None).cast("double")).alias("s"), numeric.UNARY["arcsin"](F.lit(None).cast("double")).alias("i")).first()
    assert (row.r, row.m, row.s, row.i) == (2.0, -0.5, 0.0, None)


def test_correlation_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(numeric.correlation(F.col("a"), F.col("b"))).first()[0] is None


def test_cleaning(edges):
    row = edges.agg(F.max(numeric.finite(F.col("a"))).alias("m"), F.max(numeric.bounded(F.col("a"))).alias("b"), F.count_if(numeric.finite(F.col("a")).isNull()).alias("n")).first()
    assert (row.m, row.b, row.n) == (1e16, 1e16, 0)


def test_all_or_nothing_numbers(spark):
    df = spark.createDataFrame([(1, "1,234", "7", "12%"), (2, "5", "x", "3%")], "id int, a string, b string, c string")
    roles = {r.column: r.role for r in prepare.infer_types(df).collect()}
    assert roles == {"a": "num", "b": "cat", "c": "num"}


def test_out_of_fold_encoding_does_not_leak(spark):
    rows = [(i, "ab"[i % 2], float(i), i % 3) for i in range(60)]
    changed = [(i, c, y + (1000 if k == 0 else 0), k) for i, c, y, k in rows]
    schema = "row_id int, c string, y double, fold int"
    own = lambda data: sorted(tuple(r) for r in encoders.target_out_of_fold(spark.createDataFrame(data, schema), "c", "y", "fold").where("fold = 0").select("row_id", "c_target").collect())
    assert own(rows) == own(changed)


def test_encoder_unknown_and_missing(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 6.0)], "c string, y double")
    new = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    out = {r.c: (r.c_target, r.c_count) for r in encoders.CategoricalEncoder(target=["c"], count=["c"], label="y").fit(train).transform(new).collect()}
    assert out["z"] == (3.0, 0) and out["a"][1] == 2 and out[None][1] == 1
    with pytest.raises(ValueError):
        encoders.CategoricalEncoder(target=["c"]).fit(train)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "row_id long, a double, c string, y double, fold int")
    assert folds.kfold(none).count() == 0 and folds.stratified_regression(none, "y").count() == 0
    assert profile.missing(none, ["a", "c"]).count() == 1 and profile.binned_entropy(none, ["a"]).count() == 1
    assert prepare.impute(none, none, ["a"], ["c"]).count() == 0
    assert metrics.auc(none.withColumn("l", F.lit(1)), "l", "a").count() <= 1


def test_stratified_folds_differ_by_one(spark):
    df = spark.range(103).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("k"))
    sizes = [r["count"] for r in folds.stratified(df, "k").groupBy("k", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_bins_with_ties(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 90 else float(i)) for i in range(100)], "row_id int, y double")
    assert folds.quantile_bins(df, "y").where("y = 1").select("bin").distinct().count() == 1


def test_fixed_windows_keep_order(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.col("id").alias("t"))
    for r in folds.fixed_window(df, ["t", "row_id"], 3, 10, 40, 5).groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("row_id"))).alias("a"), F.min(F.when(F.col("role") == "val", F.col("row_id"))).alias("b"), F.count_if(F.col("role") == "val").alias("n")).collect():
        assert r.n == 10 and r.b - r.a == 6
    with pytest.raises(ValueError):
        folds.fixed_window(df, ["t"], 3, 50, 60)


def test_neighbours_with_repeated_places(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (2, 3.0, 4.0), (3, None, 1.0)], "row_id int, x double, y double")
    xy = [F.col("x"), F.col("y")]
    got = {r.row_id: r.distances for r in spatial.nearest(df, df, xy, xy, 3, "row_id", 1.0, 8.0).collect()}
    assert got == {0: [0.0, 0.0, 5.0], 1: [0.0, 0.0, 5.0], 2: [0.0, 5.0, 5.0]}


def test_geo_weights_use_every_row(spark, tmp_path):
    made = "id AS event_id, id % 3 AS user_id, CAST(id % 3 AS STRING) AS event_type, CAST(id AS DOUBLE) AS value"
    spark.range(40).selectExpr(*made.split(", ")).write.parquet(f"{tmp_path}/events.parquet")
    at = {r.row_id: (r.latitude, r.longitude) for r in frame(spark, str(tmp_path), "obs").collect() if r.latitude is not None}
    raw = {}
    for i in at:
        if i % 4:
            near = sorted(math.dist(at[i], at[j]) for j in at if j % 4 == 0)[:10]
            raw[i] = 1 / (1 + sum(near) / len(near))
    mean = sum(raw.values()) / len(raw)
    got = {r.row_id: r.weight for r in queries()["weight_geo_knn"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({i: w / mean for i, w in raw.items()}, abs=1e-6)


def test_geo_weights_ask_once_a_place(spark, monkeypatch):
    asked = []
    nearest = spatial.nearest
    monkeypatch.setattr(spatial, "nearest", lambda queries, places, at, to, k, key, start, most: asked.append((queries.count(), start)) or nearest(queries, places, at, to, k, key, start, most))
    # a crowd, some places far from it and one beyond all radii
    spots = [(i % 40 / 100, i // 40 / 100) for i in range(1600)] + [(50.0, 3.0 * i) for i in range(5)] + [(9000.0, 0.0)]
    train = spark.createDataFrame([(j * 10000 + i, x, y) for j in range(3) for i, (x, y) in enumerate(spots)] + [(99, None, 1.0)], "row_id long, x double, y double")
    test = spark.createDataFrame([(i, x + 0.003, y) for i, (x, y) in enumerate(spots[:-1])], "row_id long, x double, y double")
    got = {r.row_id: r.weight for r in spatial.proximity_weights(train, test, ["x", "y"], "row_id", most=64.0).collect()}
    assert len(asked) == 1 and asked[0][0] == len(spots) and asked[0][1] <= 4
    raw = {}
    for i, p in enumerate(spots[:-1]):
        near = sorted(math.dist(p, (x + 0.003, y)) for x, y in spots[:-1])[:10]
        raw[i] = 1 / (1 + sum(near) / 10)
    mean = sum(raw.values()) / len(raw)
    assert got == pytest.approx({j * 10000 + i: w / mean for j in range(3) for i, w in raw.items()}, abs=1e-9)


def test_softmax_of_large_values(spark):
    # exp(1000) is no number, the shares of 1000 and 999 are
    values = spark.createDataFrame([("a", "m", 1000.0), ("b", "m", 999.0), ("c", "m", 0.0)], "feature string, method string, value double")
    each = {"a": 1 / (1 + math.exp(-1)), "b": math.exp(-1) / (1 + math.exp(-1)), "c": 0.0}
    total = sum(map(math.exp, each.values()))
    got = {r.feature: r.value for r in importance.aggregate(values, {"m": 1.0}, normalise=True).collect()}
    assert got == pytest.approx({f: math.exp(v) / total for f, v in each.items()}, abs=1e-12)


def test_r2_cases(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "y double, p double")
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    r2 = metrics.r2(F.col("y"), F.col("p"))
    assert one.agg(r2).first()[0] == 1.0 and same.agg(r2).first()[0] == 1.0


def test_stagnation_rises_and_falls():
    p = Progress()
    for _ in range(8):
        p.record(False, False)
    assert p.level == Stagnation.CRITICAL and p.gain_factor == 0.1
    for _ in range(8):
        p.record(True, True)
    assert p.level == Stagnation.NONE


def test_catalog_round_trip_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), float(i % 4), "xy"[i % 2]) for i in range(20)], "id int, a double, b double, c string")
    catalog = Catalog.of(rows, leave=("id",))
    made = catalog.add("log", catalog.add("add", "b", "a").name)
    catalog.add("freq", "c")
    assert made.name == "a_add_b_log" and made.depth == 2 and catalog.add("add", "a", "b").name == "a_add_b"
    with pytest.raises(ValueError):
        catalog.drop("a")
    out = catalog.fit(rows).transform(rows)
    catalog.save(str(tmp_path / "catalog.json"))
    again = Catalog.load(spark, str(tmp_path / "catalog.json")).transform(rows)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.select(out.columns).collect()))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    transform.start(stream, catalog, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(out.columns).collect())) == sorted(map(str, out.collect()))


def test_search_finds_a_product(spark):
    rows = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 17 - 8).cast("double").alias("a"), (F.col("id") % 13 - 6).cast("double").alias("b"), (F.col("id") % 3).cast("int").alias("fold"))
    rows = rows.withColumn("y", F.col("a") * F.col("b")).cache()
    search = FeatureSearch("y", model=DecisionTreeRegressor(maxDepth=3, seed=1), generations=1, parents=4, children=40, stop_children=2, max_new=1, leave=("row_id",))
    out = search.fit_transform(rows)
    assert len(search.history) == 2 and search.history[1]["score"] < search.history[0]["score"] and len(out.columns) == len(rows.columns) + 1


@pytest.mark.parametrize(("stop", "found"), [(13, True), (12, False)])
def test_search_stops_after_misses_in_a_row(spark, monkeypatch, stop, found):
    df = spark.createDataFrame([(*map(float, range(16)), 1.0, 0)], ", ".join(f"x{i} double" for i in range(16)) + ", y double, fold int")
    ranked = [("log", f"x{i}", None, 1.0) for i in range(16)]
    paying = {Catalog.of(df, "y", ("fold",)).name(*ranked[i][:3]) for i in (1, 14)}
    monkeypatch.setattr("loomtab.operators.search.cross_validate", lambda made, names, *_: {"mean": 2.0 ** -len(paying & set(names))})
    monkeypatch.setattr(FeatureSearch, "_screen", lambda *_: ranked)
    search = FeatureSearch("y", generations=1, stop_children=stop)
    search.search(df)
    assert (search.history[1]["score"] == 0.25) == found


def test_stability_and_top(spark):
    values = spark.createDataFrame([("m", f, x, v) for f in (0, 1) for x, v in (("a", 3.0), ("b", 2.0), ("c", 1.0 + f * 2))], "method string, fold int, feature string, value double")
    assert importance.stability(values, 2).first().stability == pytest.approx(1 / 3)
    assert [r.feature for r in importance.top(values.where("fold = 0"), 2).collect()] == ["a", "b"]


def test_models_helpers():
    assert models.inverse_error_weights({"a": 1.0, "b": 2.0, "c": 4.0, "d": 9.0}, 2) == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}
    wide = space.space("gbt", 1_000_000, 50, "high")
    assert wide["maxIter"][1] > space.space("gbt", 1000, 50, "low")["maxIter"][1] and space.time_level(1, 1000, 10, 5.0)[0] == "low"


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "k") for i in range(30)], "id int, text string, c string")
    readers.write_predictions(df, str(tmp_path / "p.csv"), "id", "c")
    back = readers.read(spark, str(tmp_path / "p.csv"), "id int, c string")
    assert back.count() == 30 and readers.columns(spark, str(tmp_path / "p.csv")) == ["id", "c"]
    readers.append(df, str(tmp_path / "r.parquet"))
    readers.append(df, str(tmp_path / "r.parquet"))
    assert readers.read(spark, str(tmp_path / "r.parquet")).count() == 60 and readers.near_unique_text(df) == ["text"]
    assert readers.unused(df, df.where("id < 28"), 5).count() == 2
    with pytest.raises(ValueError):
        readers.read(spark, "x.xls")


def test_synthetic_timestamp(spark):
    row = spark.range(1).select(other.synthetic_timestamp(F.lit(366), F.lit(3)).isNull().alias("a"), other.synthetic_timestamp(F.lit(32), F.lit(3)).cast("string").alias("b")).first()
    assert row.a and row.b == "2023-02-01 03:00:00"


def test_search_gains_nothing_from_noise(spark):
    """A category of many values that has nothing to do with the target: encoded on each fold's training rows alone it doesn't help."""
    import random

    from pyspark.ml.regression import LinearRegression

    from loomtab.operators.folds import kfold
    from loomtab.operators.models import cross_validate
    from loomtab.operators.search import FeatureSearch
    from loomtab.plans.catalog import Catalog

    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), f"v{rng.randrange(200)}", rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, x double, c string, y double").coalesce(1).cache()
    model = LinearRegression(regParam=0.01)
    search = FeatureSearch("y", model=model, generations=1, parents=2, children=3, stop_children=3, leave=("row_id",), cv=3)
    found = search.search(df)
    assert not any(f.op == "target" for f in found.features.values())
    leaking = Catalog.of(df, "y", ("row_id",))
    leaking.add("target", "c")
    made = kfold(leaking.fit(df).transform(df), 3)
    assert cross_validate(made, ["x", "c_target"], "y", model)["mean"] < 0.95 * search.history[0]["score"]


def test_operation_priority_falls_with_failures():
    from loomtab.operators.search import OperationStats

    stats = OperationStats()
    stats.record(0.05, True)
    assert abs(stats.priority - (0.7 * 0.55 + 0.3 * 0.05)) < 1e-12
    for _ in range(9):
        stats.record(-1.0, False)
    assert abs(stats.priority - 0.5 * (0.7 * 0.55 * 0.9**9 + 0.3 * 0.05)) < 1e-12


def test_log_loss_scores_probabilities(spark):
    import math

    from pyspark.ml.linalg import Vectors

    from loomtab.operators.metrics import SCORERS

    df = spark.createDataFrame([(1.0, 1.0, Vectors.dense(0.2, 0.8)), (0.0, 1.0, Vectors.dense(0.4, 0.6))], ["label", "prediction", "probability"])
    assert abs(SCORERS["log_loss"].score(df) + (math.log(0.8) + math.log(0.4)) / 2) < 1e-9
    assert abs(SCORERS["accuracy"].score(df) - 0.5) < 1e-6

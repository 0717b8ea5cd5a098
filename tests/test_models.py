from __future__ import annotations

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesops.models import sequence, trees, trend
from salesops.models.grouped import fit_grouped, forecast_grouped
from salesops.operators import series
from salesops.plans import evaluation, forecasting, training, views
from salesops.plans.lineage import scratch_path
from salesops.sources import modelstore
from tests.conftest import plan, rows


def month(i: int) -> datetime.date:
    return datetime.date(2018 + i // 12, i % 12 + 1, 1)


def make(spark, by_region: dict[int, list]):
    data = [(k, month(i), v) for k, values in by_region.items() for i, v in enumerate(values)]
    return spark.createDataFrame(data, "Region int, ds date, y double")


def wave(n: int, level: float = 100.0) -> list[float]:
    return [level + 2.0 * i + 10.0 * math.sin(2 * math.pi * i / 12) + (i * 7 % 5) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    return make(spark, {1: wave(48), 2: wave(30, 900.0), 3: wave(13), 4: wave(12), 5: wave(2), 6: wave(1)}).cache()


# --- trend -----------------------------------------------------------------------------------


def brute_trend(values: list[float], mode: str, horizon: int):
    t = np.array([(month(i).year - 2000) * 12 + month(i).month - 1 for i in range(len(values))], float)
    y = np.array(values)
    slope, intercept = np.polyfit(t, y, 1)
    line = intercept + slope * t
    effect = y - line if mode == "additive" else y / line - 1
    season = np.zeros(12)
    if t[-1] - t[0] >= 24:
        for m in range(12):
            if (t % 12 == m).any():
                season[m] = effect[t % 12 == m].mean()
    apply = (lambda a, s: a + s) if mode == "additive" else (lambda a, s: a * (1 + s))
    sigma = (y - apply(line, season[(t % 12).astype(int)])).std(ddof=1)
    future = t[-1] + np.arange(1, horizon + 1)
    return apply(intercept + slope * future, season[(future % 12).astype(int)]), sigma


@pytest.mark.parametrize("mode", trend.MODES)
def test_trend_matches_brute_force(data, mode):
    found = forecasting.trend_forecast(data, "region", 5, mode=mode).orderBy("Region", "ds").collect()
    assert sorted({r["Region"] for r in found}) == [1, 2, 3, 4, 5]
    for region, n, level in ((1, 48, 100.0), (2, 30, 900.0), (3, 13, 100.0)):
        yhat, sigma = brute_trend(wave(n, level), mode, 5)
        mine = [r for r in found if r["Region"] == region]
        assert [r["ds"] for r in mine] == [month(n + i) for i in range(5)]
        assert [r["yhat"] for r in mine] == pytest.approx(list(yhat), rel=1e-9)
        assert mine[0]["yhat_upper"] - mine[0]["yhat"] == pytest.approx(1.2816 * sigma, rel=1e-7)
        assert mine[0]["yhat"] - mine[0]["yhat_lower"] == pytest.approx(1.2816 * sigma, rel=1e-7)


def test_trend_rejects(data):
    with pytest.raises(ValueError):
        trend.fit_trend(data, "region", "cubic")
    with pytest.raises(ValueError):
        forecasting.trend_forecast(data, "region", 0)


def test_forecast_rows_and_filters(data):
    forecast = forecasting.trend_forecast(data, "region", 7, {"Region": "2", "Shelf": 1})
    assert forecast.count() == 7
    nested = forecasting.nested_forecast(forecast, "region").first()
    assert nested["key"] == "2" and len(nested["forecast"]) == 7
    assert nested["forecast"][0]["ds"] == month(30).isoformat()


def test_stored_models_skip_untrained_keys(spark, data):
    path = scratch_path(spark, "models")
    assert modelstore.load_models(spark, path, "region", "trend") is None
    modelstore.save_models(trend.fit_trend(data.filter("Region <= 2"), "region"), path, "region", "trend")
    modelstore.save_models(trees.fit_mean(trees.train_rows(data, "region"), "region"), path, "region", "mean")
    stored = modelstore.load_models(spark, path, "region", "trend")
    # The newest month comes from the series, not from the stored model.
    longer = data.unionByName(make(spark, {1: wave(49)}).filter(F.col("ds") == F.lit(month(48))))
    forecast = forecasting.trend_forecast(longer, "region", 1, models=stored)
    assert sorted(rows(forecast.select("Region", "ds"))) == [(1, month(49)), (2, month(30))]
    assert evaluation.evaluate_trend(data, "region", stored).count() == 2
    modelstore.save_models(trend.fit_trend(data.filter("Region = 3"), "region"), path, "region", "trend")
    assert rows(modelstore.load_models(spark, path, "region", "trend").select("Region")) == [(3,)]
    assert modelstore.load_models(spark, path, "region", "mean").count() == 3
    report = modelstore.training_report(trend.fit_trend(data, "region"), "region")
    assert sorted(rows(report))[0] == (1, "ok", 48)


def test_stored_and_direct_evaluation_agree(data):
    direct = evaluation.evaluate_trend(data, "region").orderBy("Region").toPandas()
    joined = evaluation.evaluate_trend(data, "region", trend.fit_trend(data, "region")).orderBy("Region").toPandas()
    assert np.allclose(direct.to_numpy(dtype=float), joined.to_numpy(dtype=float))


# --- metrics ---------------------------------------------------------------------------------


def test_error_metrics(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 1.0), (1, 0.0, 1.0), (2, 0.0, 3.0), (3, 1.0, float("nan")), (3, 1.0, 2.0)],
        "Region int, y double, yhat double",
    )
    found = {r["Region"]: tuple(r)[1:] for r in evaluation.error_metrics(df, ["Region"]).collect()}
    assert found[1] == (2, 1.0, 1.0, 50.0)
    assert found[2] == (1, 3.0, 3.0, None)
    assert found[3] == (2, 1.0, 1.0, 100.0)
    summary = evaluation.summarize(evaluation.error_metrics(df, ["Region"])).first()
    assert (summary["groups"], summary["mape"]) == (3, 75.0)
    first = df.filter("Region = 1")
    both = {n: evaluation.error_metrics(d, ["Region"]) for n, d in (("a", df), ("b", first))}
    compared = {r["model"]: r["groups"] for r in evaluation.compare_models(both).collect()}
    assert compared == {"a": 3, "b": 1}


# --- mean and trees --------------------------------------------------------------------------


def test_mean_model_needs_thirteen_rows(data):
    found = {r["Region"]: r for r in trees.fit_mean(trees.train_rows(data, "region"), "region").collect()}
    assert sorted(found) == [1, 2, 3]
    assert found[3]["n_obs"] == 1 and found[3]["mean_y"] == wave(13)[12]
    assert found[2]["mean_y"] == pytest.approx(np.mean(wave(30, 900.0)[12:]))


def test_short_keys_forecast_their_mean(data):
    # Below 40 training rows configuration A cannot split: every forecast is the key's mean.
    forecast = forecasting.tree_forecast(data, "region", trees.TREES_A, 3)
    expected = {k: np.mean(v[12:]) for k, v in ((1, wave(48)), (2, wave(30, 900.0)), (3, wave(13)))}
    found = rows(forecast.select("Region", "yhat", "yhat_lower", "yhat_upper"))
    assert len(found) == 9
    for region, yhat, low, high in found:
        assert yhat == low == high == pytest.approx(expected[region])


@pytest.fixture(scope="module")
def small_trees(spark, data):
    params = trees.TreeParams(rounds=5, step=0.3, depth=3, leaf_rows=1, bins=32)
    features = trees.train_rows(data, "region")
    return params, features, trees.fit_trees(features, "region", params)


def plain_walk(model, region: int, row: list, mean: float) -> float:
    """The mean and one leaf of every tree of the region, node by node."""
    for tree in model:
        if tree["Region"] == region:
            node = 0
            while tree["feature"][node] >= 0:
                node = tree["left"][node] + (row[tree["feature"][node]] > tree["value"][node])
            mean += tree["value"][node]
    return mean


def test_tree_recursion_matches_brute_force(spark, data, small_trees):
    params, features, model = small_trees
    per_key = trees.fit_keys(features, "region", params)
    means = {r["Region"]: r["mean_y"] for r in per_key.collect()}
    found = trees.forecast_trees(data, per_key, model, "region", 4).orderBy("Region", "ds").collect()
    nodes = model.collect()
    for region, values in ((1, wave(48)), (2, wave(30, 900.0)), (3, wave(13))):
        history = list(values)
        for step in range(4):
            ds = month(len(history))
            row = [*(history[-k] for k in (1, 2, 3, 6, 12)), ds.month, ds.year]
            history.append(plain_walk(nodes, region, row, means[region]))
        mine = [r for r in found if r["Region"] == region]
        assert [r["yhat"] for r in mine] == pytest.approx(history[len(values):], rel=1e-9)
        assert [r["ds"] for r in mine] == [month(len(values) + i) for i in range(4)]


def test_trees_fit_better_than_the_mean(data, small_trees):
    params, features, model = small_trees
    per_key = trees.fit_keys(features, "region", params)
    fitted = evaluation.evaluate_trees(features, per_key, model, "region")
    means = evaluation.evaluate_mean(features, "region")
    better = {r["Region"]: r["rmse"] for r in fitted.collect()}
    plain = {r["Region"]: r["rmse"] for r in means.collect()}
    assert better[1] < plain[1] and better[2] < plain[2]
    stored = evaluation.evaluate_mean(features, "region", per_key)
    assert {r["Region"]: r["rmse"] for r in stored.collect()} == pytest.approx(plain)


def test_unknown_history_leaves_a_key_out(spark, small_trees):
    params, features, model = small_trees
    holes = wave(20)
    holes[-5] = None
    data = make(spark, {1: holes, 2: wave(20)})
    columns = "Region int, mean_y double, n_obs long, scale double, mean_below int"
    per_key = spark.createDataFrame([(1, 100.0, 8, 100.0, 0), (2, 100.0, 8, 100.0, 0)], columns)
    # One step reads lags 1, 2, 3, 6 and 12: the hole five back is not read yet.
    one = trees.forecast_trees(data, per_key, model, "region", 1)
    assert sorted(r[0] for r in rows(one.select("Region"))) == [1, 2]
    two = trees.forecast_trees(data, per_key, model, "region", 2)
    assert {r[0] for r in rows(two.select("Region"))} == {2}


def test_trees_survive_a_store(spark, data, small_trees):
    params, features, model = small_trees
    path = scratch_path(spark, "trees")
    trees.save_trees(model, path)
    again = trees.load_trees(spark, path)
    per_key = trees.fit_keys(features, "region", params)
    before = rows(trees.forecast_trees(data, per_key, model, "region", 2).orderBy("Region", "ds"))
    after = rows(trees.forecast_trees(data, per_key, again, "region", 2).orderBy("Region", "ds"))
    assert before == after


# --- the stored lifecycle --------------------------------------------------------------------


def test_lifecycle(spark, data):
    path = scratch_path(spark, "life")
    params = {"trees_a": SHORT, "trees_b": SHORT}
    trained = {}
    for model in training.MODELS:
        assert training.forecast(data, path, "region", model).count() == 0
        assert training.evaluate(data, path, "region", model).count() == 0
        report = training.train(data, path, "region", model, params=params.get(model))
        trained[model] = sorted(r["Region"] for r in report.collect())
    assert trained == {"trend": [1, 2, 3, 4, 5], "changepoint": [1, 2, 3, 4, 5], "trees_a": [1, 2, 3], "trees_b": [1, 2, 3], "sequence": [1, 2, 3]}
    for model in training.MODELS:
        forecast = training.forecast(data, path, "region", model, 4, {"Region": 1})
        assert forecast.columns == ["Region", "ds", "yhat", "yhat_lower", "yhat_upper"]
        found = rows(forecast.select("Region", "ds").orderBy("ds"))
        assert found == [(1, month(48 + i)) for i in range(4)]
        assert training.evaluate(data, path, "region", model).count() == len(trained[model])
    compared = {r["model"]: r["groups"] for r in training.compare(data, path, "region").collect()}
    assert compared == {"trend": 5, "trees_a": 3, "trees_b": 3}
    with pytest.raises(ValueError):
        training.train(data, path, "region", "forest")


SHORT = trees.TreeParams(rounds=2, step=0.3, depth=2, leaf_rows=1, bins=32)


def test_trees_are_written_to_the_store_only(spark, data, monkeypatch):
    """They are many times their rows: a forecast keeps none, and a training does not write them before it stores them."""
    names, write = [], trees.written
    monkeypatch.setattr(trees, "written", lambda df, name: names.append(name) or write(df, name))
    assert forecasting.tree_forecast(data, "region", SHORT, 2).count() == 6
    assert training.train(data, scratch_path(spark, "life"), "region", "trees_b", params=SHORT).count() == 3
    assert names == ["tree-rows", "tree-rows"]


def test_training_on_nothing(spark, data):
    path = scratch_path(spark, "life")
    empty = data.filter("false")
    for model in training.MODELS:
        assert training.train(empty, path, "region", model).count() == 0
        assert training.forecast(empty, path, "region", model).count() == 0


def test_training_on_nothing_replaces_the_models(spark, data):
    path = scratch_path(spark, "life")
    for model in training.MODELS:
        assert training.train(data, path, "region", model, params=SHORT).count() > 0
        assert training.train(data.filter("false"), path, "region", model, params=SHORT).count() == 0
        assert training.forecast(data, path, "region", model).count() == 0
        assert training.evaluate(data, path, "region", model).count() == 0


def test_reasons_for_nothing(spark, data):
    survey = spark.createDataFrame([(2020, None), (2020, 1)], "YEAR_NO int, MONTH_NO int")
    path = scratch_path(spark, "life")
    report = training.train(data.filter("false"), path, "region", "trend")
    assert rows(training.with_reason(report, survey, "region")) == [(None, None, "no data", 2, 1)]
    forecast = training.forecast(data, path, "region", "trend")
    found = training.with_reason(forecast, survey, "region", "no models").first()
    assert (found["status"], found["rows_all"], found["Region"]) == ("no models", 2, None)
    trained = training.with_reason(training.train(data, path, "region", "trend"), survey, "region").collect()
    assert {r["status"] for r in trained} == {"ok"} and {r["rows_with_period"] for r in trained} == {1}


def test_a_model_that_does_not_load_is_reported(spark, data):
    path = scratch_path(spark, "life")
    training.train(data, path, "region", "trees_b", params=SHORT)
    training.train(data, path, "region", "trend")
    version = modelstore.current(spark, f"{path}/models", "region", "trees_b")
    spark.range(1).write.mode("overwrite").parquet(f"{version.folder}/trees")
    assert training.forecast(data, path, "region", "trees_b").count() == 0
    found = training.evaluate_all(data, path, "region", ("trend", "trees_a", "trees_b")).collect()
    status = {r["model"]: r["status"] for r in found}
    assert status["trend"] == "ok" and status["trees_a"] == "no models"
    assert status["trees_b"].startswith("error: ")
    assert sum(r["model"] == "trend" for r in found) == 5


def test_a_training_that_breaks_off_changes_nothing(spark, data, monkeypatch):
    """Keys of one fit never meet the trees of another: without its commit a version does not count."""
    path = scratch_path(spark, "life")
    training.train(data, path, "region", "trees_b", params=SHORT)
    before = rows(training.forecast(data, path, "region", "trees_b", 2).orderBy("Region", "ds"))
    opened = modelstore.current(spark, f"{path}/models", "region", "trees_b")
    lost = trees.fit_trees

    def broken(*args):
        return lost(*args).withColumn("value", F.raise_error(F.lit("lost")))

    monkeypatch.setattr(trees, "fit_trees", broken)
    with pytest.raises(Exception, match="lost"):
        training.train(data.filter("Region = 1"), path, "region", "trees_b", params=SHORT)
    assert rows(training.forecast(data, path, "region", "trees_b", 2).orderBy("Region", "ds")) == before
    monkeypatch.setattr(trees, "fit_trees", lost)
    training.train(data.filter("Region = 1"), path, "region", "trees_b", params=SHORT)
    assert {r["Region"] for r in training.forecast(data, path, "region", "trees_b", 2).collect()} == {1}
    # A reader that opened the version before still finds it.
    assert opened.part(spark).count() == 3
    for _ in range(2):
        training.train(data.filter("Region = 2"), path, "region", "trees_b", params=SHORT)
    found = modelstore.versions(spark, f"{path}/models", "region", "trees_b")
    assert [v.number for v in found] == [4, 3, 2]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found[0].folder).getParent()
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert len(files.listStatus(folder)) == modelstore.KEPT


def test_the_rule_for_short_keys_is_stored(spark, data):
    path = scratch_path(spark, "life")
    always_mean = trees.TreeParams(rounds=2, step=0.3, depth=2, leaf_rows=1, bins=32, mean_below=1000)
    training.train(data, path, "region", "trees_b", params=always_mean)
    found = training.forecast(data, path, "region", "trees_b", 2).filter("Region = 1").collect()
    assert {round(r["yhat"], 6) for r in found} == {round(float(np.mean(wave(48)[12:])), 6)}


def test_trees_are_repeated_exactly(data):
    params = trees.TreeParams(
        rounds=8, step=0.3, depth=4, leaf_rows=1, bins=32, row_share=0.7, column_share=0.5
    )
    first = rows(forecasting.tree_forecast(data, "region", params, 3).orderBy("Region", "ds"))
    shuffled = data.repartition(7, "ds")
    assert rows(forecasting.tree_forecast(shuffled, "region", params, 3).orderBy("Region", "ds")) == first


def test_every_key_has_trees_of_its_own(spark):
    """A key of another pattern and size changes nothing in the trees of the first."""
    both = trees.train_rows(make(spark, {1: wave(60), 2: [(-1) ** i * 1e6 + i for i in range(80)]}), "region")
    alone = trees.train_rows(make(spark, {1: wave(60)}), "region")
    fits = [trees.fit_trees(f, "region", SHORT).filter("Region = 1").orderBy("tree") for f in (both, alone)]
    assert rows(fits[0]) == rows(fits[1])


def test_a_long_horizon_keeps_its_plan(spark, data, small_trees):
    params, features, model = small_trees
    per_key = trees.fit_keys(features, "region", params)
    long = trees.forecast_trees(data, per_key, model, "region", 26).filter("Region = 1").orderBy("ds").collect()
    short = trees.forecast_trees(data, per_key, model, "region", 11).filter("Region = 1").orderBy("ds").collect()
    assert [r["yhat"] for r in long[:11]] == pytest.approx([r["yhat"] for r in short]) and len(long) == 26
    plans = [plan(trees.forecast_trees(data, per_key, model, "region", h)).count("\n") for h in (1, 60)]
    assert plans[0] == plans[1]


# --- sequence and the hook -------------------------------------------------------------------


def test_sequence_matches_brute_force(data):
    window, horizon, ridge = 12, 6, 0.1
    models = sequence.fit_sequence(data, "region", window, ridge)
    assert sorted(r[0] for r in rows(models.select("Region"))) == [1, 2, 3]
    found = sequence.forecast_sequence(data, models, "region", horizon, window).orderBy("Region", "ds").collect()
    for region, values in ((1, wave(48)), (2, wave(30, 900.0)), (3, wave(13))):
        y = np.array(values)
        z = (y - y.mean()) / np.abs(y).mean()
        x = np.array([z[i - window : i] for i in range(window, len(z))])
        coef = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(window), x.T @ z[window:])
        history = list(z)
        for _ in range(horizon):
            history.append(float(np.dot(history[-window:], coef)))
        expected = np.array(history[len(z):]) * np.abs(y).mean() + y.mean()
        mine = [r for r in found if r["Region"] == region]
        assert [r["yhat"] for r in mine] == pytest.approx(list(expected), rel=1e-9)
        assert [r["ds"] for r in mine] == [month(len(values) + i) for i in range(horizon)]
    metrics = evaluation.evaluate_sequence(data, models, "region")
    assert {r["Region"]: r["count"] for r in metrics.collect()} == {1: 36, 2: 18, 3: 1}


def test_own_library_per_key(data):
    def last_value(group: pd.DataFrame) -> dict:
        return {"value": float(group["y"].iloc[-1]), "n": len(group)}

    models = fit_grouped(data, "region", last_value, "value double, n long", min_rows=13)
    assert sorted(rows(models)) == [
        (1, wave(48)[-1], 48),
        (2, wave(30, 900.0)[-1], 30),
        (3, wave(13)[-1], 13),
    ]


def test_own_library_forecasts_and_scores(data):
    models = fit_grouped(
        data, "region", lambda g: {"first": float(g["y"].iloc[0]), "last": float(g["y"].iloc[-1])},
        "first double, last double", min_rows=13,
    )

    def ahead(rows: pd.DataFrame, model: pd.Series) -> pd.Series:
        assert list(rows["ds"]) == sorted(rows["ds"])
        return pd.Series(model["last"], index=rows.index) + np.arange(1, len(rows) + 1)

    forecast = forecast_grouped(data, models, "region", ahead, 2).orderBy("Region", "ds").collect()
    assert [(r["Region"], r["ds"]) for r in forecast[:2]] == [(1, month(48)), (1, month(49))]
    assert [r["yhat"] for r in forecast[:2]] == [wave(48)[-1] + 1, wave(48)[-1] + 2]
    assert len(forecast) == 6 and all(r["yhat"] == r["yhat_lower"] == r["yhat_upper"] for r in forecast)
    score = evaluation.evaluate_grouped(data, models, "region", lambda rows, model: rows["y"] * 0 + model["first"])
    found = {r["Region"]: r["mae"] for r in score.collect()}
    assert found[2] == pytest.approx(np.mean(np.abs(np.array(wave(30, 900.0)) - wave(30, 900.0)[0])))
    assert sorted(found) == [1, 2, 3]


# --- views -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def forecast(spark):
    data = [
        (region, area, territory, datetime.date(2023 + m // 12, m % 12 + 1, 1), 1.0 * territory, 0.5, 2.0)
        for region, area, territory in ((1, 11, 111), (1, 11, 112), (1, None, 121), (2, 21, 211))
        for m in (11, 12)
    ]
    return spark.createDataFrame(
        data, "Region int, Area int, Territory int, ds date, yhat double, yhat_lower double, yhat_upper double"
    )


def test_views_sum_to_the_total(forecast):
    found = views.forecast_views(forecast).toPandas()
    total = 2 * (111 + 112 + 121 + 211)
    assert found.groupby("view")["yhat"].sum().to_dict() == {
        "yearly_total": total,
        "year_month_total": total,
        "year_month_territory_total": total,
        "year_month_area_total": total,
    }
    areas = found[found["view"] == "year_month_area_total"]
    # The NULL area is a group of its own.
    assert len(areas) == 6 and areas["Area"].isna().sum() == 2
    assert len(found[found["view"] == "yearly_total"]) == 2


def test_view_selection_and_status(forecast):
    one = views.forecast_views(forecast, ["year_month_area_total", "year_month_product_wise"])
    assert {r["view"] for r in one.collect()} == {"year_month_area_total"}
    status = {r["view"]: r for r in views.view_status(forecast.drop("Territory", "Area")).collect()}
    assert len(status) == 10
    assert status["yearly_total"]["status"] == "ok"
    assert status["year_month_area_selected_product"]["missing_dims"] == ["Area", "Product"]
    none = views.forecast_views(forecast, ["yearly_product_wise"])
    assert none.count() == 0 and "view" in none.columns
    with pytest.raises(ValueError):
        views.forecast_views(forecast, ["daily"])


def test_grid(forecast):
    areas = views.forecast_grid(forecast, "territory", ["Area", "Product"])
    assert areas.count() == 6
    assert areas.first()["missing_dims"] == ["Product"]
    keys = views.forecast_grid(forecast, "territory", ["Product"])
    assert keys.count() == 8 and {"Region", "Area", "Territory"} <= set(keys.columns)
    assert {(r["Year"], r["Month"]) for r in keys.collect()} == {(2023, 12), (2024, 1)}


def test_features_do_not_cross_keys(data):
    lagged = series.lag_features(data, "region", (1,)).filter("ds = DATE'2018-01-01'")
    assert {r["lag_1"] for r in lagged.collect()} == {None}

"""Every registered query: the library's operators over the driver tables.

Measures that come out of floating-point sums are rounded here, after the operator, to be
comparable with the reference SQL; dates are given as text and arrays as columns or text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesops.functions.columns import as_text_date, key_label
from salesops.models import changepoint, sequence, trees, trend
from salesops.models.grouped import fit_grouped, forecast_grouped
from salesops.operators import hierarchy, market, product, quality, sales, series
from salesops.plans import evaluation, forecasting, training, views
from salesops.plans.lineage import scratch_path
from salesops.scopes import SCOPES
from salesops.sources import modelstore, tables
from salesops.sources.history import SalesHistory, changes
from salesops.sources import starschema as star

Query = Callable[[SparkSession, str], DataFrame]

# Digits of fitted money values: they are in the millions and carry the noise of sums taken in a
# different order, so cents would now and then round apart.
FITTED = 0


def plain(df: DataFrame, digits: int = 2, **by_column: int) -> DataFrame:
    """Doubles rounded, whole numbers as bigint, dates as text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, by_column.get(field.name, digits))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        elif isinstance(field.dataType, T.DateType):
            column = as_text_date(column)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _series(spark: SparkSession, folder: str, scope: str = "territory") -> DataFrame:
    amounts = series.aggregated_series(star.sales_history(spark, folder), scope)
    return series.monthly_series(amounts, scope)


def _prepared(spark: SparkSession, folder: str, scope: str = "territory") -> DataFrame:
    return forecasting.prepared(_series(spark, folder, scope))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return trees.train_rows(_series(spark, folder), "territory")


def _over(source, operator, **options) -> Query:
    """A query that applies one operator to one source table."""
    digits = options.pop("digits", 2)
    by_column = options.pop("by_column", {})

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(operator(source(spark, folder), **options), digits, **by_column)

    return run


def _by_place(operator, **options) -> Query:
    """A query that sums lines by place: the operator gets the lines and the places apart."""
    digits = options.pop("digits", 2)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        places = star.places(spark, folder)
        return plain(operator(star.quality_lines(spark, folder), places=places, **options), digits)

    return run


def _sales_sample(spark: SparkSession, folder: str) -> DataFrame:
    lines = star.circle_lines(spark, folder)
    return plain(sales.sales_sample(lines, attach=lambda newest: star.with_circle(newest, folder)))


def _sales_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    lines = star.circle_lines(spark, folder)
    lookups = {"TERRITORY_ID": star.places(spark, folder), "l_orderkey": star.circles(spark, folder)}
    return plain(sales.sales_value_counts(lines, lookups=lookups))


def _named_sql(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue per return flag of one year, by SQL with bound parameters."""
    star.table(spark, folder, "lineitem").createOrReplaceTempView("shipped_lines")
    sql = """SELECT l_returnflag, count(*) AS n, sum(l_quantity * l_extendedprice) AS amount FROM shipped_lines
        WHERE year(l_shipdate) = :year AND l_quantity >= :least GROUP BY l_returnflag"""
    return plain(tables.query(spark, sql, {"year": 1996, "least": 10}))


def _source_fallback(spark: SparkSession, folder: str) -> DataFrame:
    history, survey = star.sales_history(spark, folder), star.quality_lines(spark, folder)
    places, lines = star.places(spark, folder), star.clean_lines(spark, folder)
    return plain(series.sales_amounts(history, survey, "area", probe=lines, places=places))


def _source_fallback_survey(spark: SparkSession, folder: str) -> DataFrame:
    survey, places = star.quality_lines(spark, folder), star.places(spark, folder)
    return plain(series.sales_amounts(None, survey, "region", places=places))


def _period_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    survey, places = star.text_period_lines(spark, folder), star.places(spark, folder)
    return plain(series.sanitize_period(series.scope_series(survey, "area", places=places)))


def _monthly_series(scope: str) -> Query:
    return lambda spark, folder: plain(_series(spark, folder, scope))


def _lag_features(spark: SparkSession, folder: str) -> DataFrame:
    lagged = series.lag_features(_series(spark, folder), "territory", (1, 2, 3, 6, 12))
    return plain(series.calendar_features(lagged))


def _training_features(spark: SparkSession, folder: str) -> DataFrame:
    return plain(_features(spark, folder))


def _sequence_windows(spark: SparkSession, folder: str) -> DataFrame:
    windows = series.sequence_windows(_series(spark, folder), "territory", 12)
    values = [F.col("x")[i].alias(f"x_{i + 1}") for i in range(12)]
    return plain(windows.select("Region", "Area", "Territory", "ds", *values, "y"))


def _last_periods(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.last_periods(_series(spark, folder), "territory"))


def _mean_model(spark: SparkSession, folder: str) -> DataFrame:
    return plain(trees.fit_mean(_features(spark, folder), "territory"), 3)


def _trend_fit(mode: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        models = trend.fit_trend(_series(spark, folder), "territory", mode)
        digits = FITTED if mode == "additive" else 6
        effects = {f"season_{m}": F.element_at("seasonal", m) for m in range(1, 13)}
        wide = models.withColumns(effects).drop("seasonal")
        return plain(wide, FITTED, **{name: digits for name in effects})

    return run


def _trend_forecast(scope: str, mode: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(forecasting.trend_forecast(_series(spark, folder, scope), scope, mode=mode), FITTED)

    return run


def _stored_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Train, store, read back, forecast the areas of one region from the stored models."""
    data, path = _prepared(spark, folder, "area"), scratch_path(spark, "models")
    training.train(data, path, "area", "trend")
    wanted = {"Region": 1, "Shelf": 9}
    return plain(training.forecast(data, path, "area", "trend", 12, wanted), FITTED)


def _training_report(spark: SparkSession, folder: str) -> DataFrame:
    report = training.train(_series(spark, folder), scratch_path(spark, "models"), "territory", "trend")
    return report.withColumn("model_key", key_label(SCOPES["territory"]))


def _forecast(spark: SparkSession, folder: str) -> DataFrame:
    return forecasting.trend_forecast(_series(spark, folder), "territory")


def _nested_forecast(spark: SparkSession, folder: str) -> DataFrame:
    nested = forecasting.nested_forecast(_forecast(spark, folder), "territory")
    months = nested.select("key", F.size("forecast").alias("months"), F.posexplode("forecast").alias("place", "m"))
    return plain(months.select("key", "months", "place", "m.*"), FITTED)


def _forecast_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = views.forecast_grid(_forecast(spark, folder), "territory", ["Area", "Product"])
    return plain(grid.withColumn("missing_dims", F.array_join("missing_dims", ",")), FITTED)


def forecast_views(spark: SparkSession, folder: str) -> DataFrame:
    return plain(views.forecast_views(_forecast(spark, folder)), FITTED)


def _view_status(spark: SparkSession, folder: str) -> DataFrame:
    lists = {c: F.array_join(c, ",") for c in ("dimensions", "missing_dims")}
    return plain(views.view_status(_forecast(spark, folder)).withColumns(lists), FITTED)


def _evaluate_trend(mode: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        metrics = evaluation.evaluate_trend(_series(spark, folder), "territory", mode=mode)
        return plain(metrics, FITTED, mape=6)

    return run


def _evaluate_stored_trend(spark: SparkSession, folder: str) -> DataFrame:
    data, path = _prepared(spark, folder, "area"), scratch_path(spark, "models")
    training.train(data, path, "area", "trend")
    return plain(training.evaluate(data, path, "area", "trend"), FITTED, mape=6)


def _evaluate_mean(spark: SparkSession, folder: str) -> DataFrame:
    return plain(evaluation.evaluate_mean(_features(spark, folder), "territory"), FITTED, mape=6)


def _evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    metrics = evaluation.evaluate_trend(_series(spark, folder), "territory")
    return plain(evaluation.summarize(metrics), FITTED, mape=6)


def _compare_models(spark: SparkSession, folder: str) -> DataFrame:
    data = _prepared(spark, folder)
    metrics = {
        "trend": evaluation.evaluate_trend(data, "territory"),
        "mean": evaluation.evaluate_mean(trees.train_rows(data, "territory"), "territory"),
    }
    return plain(evaluation.compare_models(metrics), FITTED, mape=6)


def _tree_forecast(params: trees.TreeParams, scope: str = "territory") -> Query:
    """What SQL can tell of a tree forecast: its rows, that it has one band, that it stays in reach."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        data, keys = _prepared(spark, folder, scope), SCOPES[scope]
        reach = data.groupBy(*keys).agg((3 * F.max(F.abs("y"))).alias("reach"))
        forecast = forecasting.tree_forecast(data, scope, params).join(reach, keys)
        one_band = (F.col("yhat") == F.col("yhat_lower")) & (F.col("yhat") == F.col("yhat_upper"))
        in_reach = F.abs("yhat") <= F.col("reach")
        return plain(forecast.select(*keys, "ds", one_band.alias("one_band"), in_reach.alias("in_reach")))

    return run


# Three rounds of trees of one cut, without and with a penalty on leaf values.
STUMPS_A = trees.TreeParams(rounds=3, step=0.1, leaves=2, leaf_rows=20)
STUMPS_B = trees.TreeParams(rounds=3, step=0.3, depth=1, leaf_rows=1, l2=1.0)


def _stumps(params: trees.TreeParams) -> Query:
    """What the first rounds of boosting predict for every training row."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        scope, keys = "territory", SCOPES["territory"]
        features = forecasting.prepared(trees.train_rows(_series(spark, folder), scope))
        rows = features.join(trees.fit_keys(features, scope, params), keys)
        predicted = trees.predict_trees(rows, trees.fit_trees(features, scope, params), scope)
        return plain(predicted.select(*keys, "ds", "yhat"), FITTED)

    return run


def _maintained_history(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches, one sent twice: early facts; late ones; every seventh fact corrected to twice its quantity."""
    lines, places = star.clean_lines(spark, folder), star.places(spark, folder)
    kept = SalesHistory(spark, scratch_path(spark, "history"))
    early = F.col("YEAR_NO") < 1995
    kept.commit("early", changes(lines.filter(early)), places)
    kept.commit("late", changes(lines.filter(~early)), places)
    kept.commit("early", changes(lines.filter(early)), places)
    kept.compact()
    wrong = lines.filter(F.col("ROW_DATA_ID") % 7 == 0)
    kept.commit("corrections", changes(wrong.withColumn("SALES_QTY", F.col("SALES_QTY") * 2), wrong), places)
    return plain(kept.read())


def _normal_equations(spark: SparkSession, folder: str) -> DataFrame:
    """The sums that a trend with changepoints is solved from: eight changes, two pairs of the year."""
    params = changepoint.ChangepointParams(changes=8, order=2)
    return plain(changepoint.normal_equations(_series(spark, folder), "territory", params), 6)


def _changepoint_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Months of every key, and whether the interval holds the value."""
    forecast = forecasting.changepoint_forecast(_prepared(spark, folder), "territory")
    inside = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return plain(forecast.select(*SCOPES["territory"], "ds", inside.alias("inside")))


def _as_good(rmse: str, other: str) -> Column:
    """Not above, up to the noise of sums."""
    return F.col(rmse) <= F.col(other) * (1 + 1e-9)


def _evaluate_trees(params: trees.TreeParams) -> Query:
    """Rows of the evaluation, and whether the trees fit every key at least as well as its mean."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        scope, keys = "territory", SCOPES["territory"]
        features = forecasting.prepared(trees.train_rows(_series(spark, folder), scope))
        model, per_key = trees.fit_trees(features, scope, params, False), trees.fit_keys(features, scope, params)
        metrics = forecasting.prepared(evaluation.evaluate_trees(features, per_key, model, scope))
        mean = evaluation.evaluate_mean(features, scope).select(*keys, F.col("rmse").alias("mean_rmse"))
        as_good = _as_good("rmse", "mean_rmse").alias("as_good_as_mean")
        return plain(metrics.join(mean, keys).select(*keys, "count", as_good))

    return run


def _sequence_forecast(scope: str = "territory") -> Query:
    return lambda spark, folder: plain(forecasting.sequence_forecast(_prepared(spark, folder, scope), scope), FITTED)


def _evaluate_sequence(spark: SparkSession, folder: str) -> DataFrame:
    data = _prepared(spark, folder)
    models = sequence.fit_sequence(data, "territory")
    return plain(evaluation.evaluate_sequence(data, models, "territory"), FITTED, mape=6)


def _own_mean(rows: pd.DataFrame) -> dict:
    """A caller's library, in short: the mean of each calendar half-year."""
    first = rows["ds"].map(lambda ds: ds.month <= 6)
    overall = rows["y"].mean()
    halves = [rows["y"][first].mean(), rows["y"][~first].mean()]
    return {"first": float(np.nan_to_num(halves[0], nan=overall)), "second": float(np.nan_to_num(halves[1], nan=overall))}


def _own_prediction(rows: pd.DataFrame, model: pd.Series) -> pd.Series:
    return rows["ds"].map(lambda ds: model["first"] if ds.month <= 6 else model["second"])


def _grouped_models(data: DataFrame) -> DataFrame:
    return fit_grouped(data, "territory", _own_mean, "first double, second double", min_rows=6)


def _grouped_forecast(spark: SparkSession, folder: str) -> DataFrame:
    data = _prepared(spark, folder)
    return plain(forecast_grouped(data, _grouped_models(data), "territory", _own_prediction), FITTED)


def _grouped_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    data = _prepared(spark, folder)
    metrics = evaluation.evaluate_grouped(data, _grouped_models(data), "territory", _own_prediction)
    return plain(metrics, FITTED, mape=6)


def _compare_stored_models(spark: SparkSession, folder: str) -> DataFrame:
    """Stored models side by side with the mean; the numbers of the trend, how the trees compare."""
    data, path = _prepared(spark, folder), scratch_path(spark, "models")
    for model in training.COMPARED:
        training.train(data, path, "territory", model)
    compared = training.compare(data, path, "territory")
    mean = evaluation.evaluate_mean(trees.train_rows(data, "territory"), "territory")
    mean = evaluation.summarize(mean).select(F.col("rmse").alias("mean_rmse"), F.lit(1).alias("_one"))
    both = compared.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one")
    numbers = {c: F.when(F.col("model") == "trend", F.col(c)) for c in ("rmse", "mae", "mape")}
    as_good = _as_good("rmse", "mean_rmse").alias("as_good_as_mean")
    shown = both.select("model", "groups", as_good, *[c.alias(n) for n, c in numbers.items()])
    return plain(shown, FITTED, mape=6)


def _model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Means of two scopes in one store; rewriting one scope leaves the other in place."""
    path = scratch_path(spark, "models")
    for scope in ("territory", "area", "territory"):
        features = trees.train_rows(_series(spark, folder, scope), scope)
        modelstore.save_models(trees.fit_mean(features, scope), path, scope, "mean")
    area = modelstore.load_models(spark, path, "area", "mean")
    territory = modelstore.load_models(spark, path, "territory", "mean")
    rows = [
        m.select(F.lit(s).alias("scope"), key_label(SCOPES[s]).alias("model_key"), "mean_y", "n_obs")
        for s, m in (("area", area), ("territory", territory))
    ]
    return plain(rows[0].unionByName(rows[1]), 3)


def _market_path(spark: SparkSession, folder: str) -> DataFrame:
    return plain(hierarchy.hierarchy_path(star.market(spark, folder), "S0"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return star.table(spark, folder, "documents")


def queries() -> dict[str, Query]:
    four = {"digits": 4}
    return {
        "sales_summary": _by_place(sales.sales_summary),
        "region_summary": _by_place(sales.region_summary),
        "region_summary_month": _by_place(sales.region_summary, year=1998, month=5),
        "monthly_trend": _over(star.quality_lines, sales.monthly_trend),
        "monthly_trend_region": _by_place(sales.monthly_trend, region_id="2"),
        "top_products": _over(star.quality_lines, sales.top_products),
        "top_products_year": _over(star.quality_lines, sales.top_products, year=1999, limit=200),
        "sales_sample": _sales_sample,
        "sales_summary_stats": _over(star.quality_lines, sales.sales_summary_stats, **four),
        "time_features": _over(star.quality_lines, sales.time_features),
        "price_change_mom": _over(star.quality_lines, sales.price_change_mom, digits=6),
        "rolling_qty": _by_place(sales.rolling_qty, **four),
        "sales_distribution": _over(star.quality_lines, sales.sales_distribution, **four),
        "sales_value_counts": _sales_value_counts,
        "time_coverage": _over(star.quality_lines, sales.time_coverage),
        "price_qty_corr": _over(star.quality_lines, sales.price_quantity_corr, digits=8),
        "region_avg_price": _by_place(sales.region_avg_price, **four),
        "product_summary": _over(star.product_dirty, product.product_summary, **four),
        "product_search": _over(
            star.product, product.product_search, product_name="wid", min_price=950.0, max_price=1500.0
        ),
        "product_missing": _over(star.product_dirty, product.product_missing, digits=6),
        "product_uniqueness": _over(star.product_dirty, product.product_uniqueness),
        "product_duplicates": _over(star.product_dirty, product.product_duplicates),
        "product_price_stats": _over(star.product_dirty, product.product_price_stats, **four),
        "product_value_counts": _over(star.product_dirty, product.product_value_counts),
        "text_quality": _over(star.product_dirty, product.product_text_quality),
        "text_quality_documents": _over(
            _documents, quality.text_quality, columns=["text", "lang", "source"], digits=6
        ),
        "generic_dosage": _over(star.product_dirty, product.generic_dosage),
        "market_summary": _over(star.market, market.market_summary),
        "market_search": _over(star.market, market.market_search, level=3, search="Supplier"),
        "market_tree": _over(star.market, hierarchy.market_tree),
        "level_distribution": _over(star.market, market.level_distribution),
        "hierarchy_integrity": _over(star.market, hierarchy.hierarchy_integrity),
        "hierarchy_orphans": _over(star.market, hierarchy.hierarchy_orphans),
        "field_uniqueness": _over(star.market, market.field_uniqueness),
        "field_duplicates": _over(star.market, market.duplicate_fields),
        "duplicate_rows": _over(star.quality_lines, quality.duplicate_keys, key="ROW_DATA_ID"),
        "market_missing": _over(star.market, market.market_missing, digits=6),
        "children_count": _over(star.market, market.children_count),
        "hierarchy_path": _market_path,
        "hierarchy_closure": _over(star.market, hierarchy.hierarchy_closure),
        "name_quality": _over(star.market, market.name_quality, digits=6),
        "scope_series_territory": _by_place(series.scope_series, scope="territory"),
        "scope_series_area": _by_place(series.scope_series, scope="area"),
        "scope_series_region": _by_place(series.scope_series, scope="region"),
        "qty_series": _by_place(series.scope_series, scope="area", measure="qty"),
        "source_fallback": _source_fallback,
        "source_fallback_survey": _source_fallback_survey,
        "period_sanitize": _period_sanitize,
        "input_diagnostics": _over(star.text_period_lines, series.input_diagnostics),
        "monthly_series": _monthly_series("territory"),
        "lag_features": _lag_features,
        "training_features": _training_features,
        "sequence_windows": _sequence_windows,
        "last_periods": _last_periods,
        "mean_model": _mean_model,
        "trend_fit": _trend_fit("additive"),
        "trend_fit_multiplicative": _trend_fit("multiplicative"),
        "trend_forecast": _trend_forecast("territory", "additive"),
        "trend_forecast_area": _trend_forecast("area", "additive"),
        "trend_forecast_region": _trend_forecast("region", "additive"),
        "trend_forecast_multiplicative": _trend_forecast("territory", "multiplicative"),
        "stored_forecast": _stored_forecast,
        "training_report": _training_report,
        "nested_forecast": _nested_forecast,
        "forecast_grid": _forecast_grid,
        "forecast_views": forecast_views,
        "view_status": _view_status,
        "evaluate_trend": _evaluate_trend("additive"),
        "evaluate_trend_multiplicative": _evaluate_trend("multiplicative"),
        "evaluate_stored_trend": _evaluate_stored_trend,
        "evaluate_mean": _evaluate_mean,
        "evaluation_summary": _evaluation_summary,
        "compare_models": _compare_models,
        "model_roundtrip": _model_roundtrip,
        "trees_a_forecast": _tree_forecast(trees.TREES_A),
        "trees_b_forecast": _tree_forecast(trees.TREES_B),
        "trees_a_forecast_area": _tree_forecast(trees.TREES_A, "area"),
        "trees_a_forecast_region": _tree_forecast(trees.TREES_A, "region"),
        "maintained_history": _maintained_history,
        "changepoint_normal_equations": _normal_equations,
        "changepoint_forecast": _changepoint_forecast,
        "boosted_stumps_a": _stumps(STUMPS_A),
        "boosted_stumps_b": _stumps(STUMPS_B),
        "evaluate_trees_a": _evaluate_trees(trees.TREES_A),
        "evaluate_trees_b": _evaluate_trees(trees.TREES_B),
        "compare_stored_models": _compare_stored_models,
        "sequence_forecast": _sequence_forecast(),
        "sequence_forecast_area": _sequence_forecast("area"),
        "sequence_forecast_region": _sequence_forecast("region"),
        "evaluate_sequence": _evaluate_sequence,
        "grouped_forecast": _grouped_forecast,
        "grouped_evaluation": _grouped_evaluation,
        "named_sql": _named_sql,
        "sales_distribution_sample": _over(star.quality_lines, sales.sales_distribution, sample_limit=3000, **four),
        "price_qty_corr_sample": _over(star.quality_lines, sales.price_quantity_corr, sample=3000, digits=8),
    }

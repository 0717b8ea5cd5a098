"""Series to models to forecasts, per scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.functions.columns import as_text_date, key_label
from salesops.functions.params import known_filters
from salesops.models import changepoint, sequence, trees, trend
from salesops.operators.series import last_periods, monthly_series, sales_amounts
from salesops.plans.lineage import cut, written
from salesops.scopes import DEFAULT_HORIZON, scope_keys


def series_of(
    history: DataFrame | None, survey: DataFrame, scope: str, measure: str | None = None
) -> DataFrame:
    """Monthly series of a scope from the first source that holds rows."""
    return monthly_series(sales_amounts(history, survey, scope, measure), scope)


def prepared(series: DataFrame) -> DataFrame:
    """The series written to the checkpoint folder.

    For work that reads it more than once, such as fitting, scoring and comparing models: the
    facts are scanned for it a single time, and a lost executor costs no second scan.
    """
    return cut(series)


def trend_forecast(
    series: DataFrame,
    scope: str,
    horizon: int = DEFAULT_HORIZON,
    filters: dict | None = None,
    mode: str = "additive",
    models: DataFrame | None = None,
) -> DataFrame:
    """Forecast from stored models, or from models fitted on the series itself.

    With stored models the forecast starts after the newest month of the series, and keys
    without a model are skipped.
    """
    wanted = known_filters(series, filters)
    if models is None:
        models = trend.fit_trend(wanted, scope, mode)
    else:
        newest = last_periods(wanted, scope)
        models = models.drop("last_ds").join(newest, scope_keys(scope))
    return trend.forecast_trend(models, scope, horizon)


def changepoint_forecast(
    series: DataFrame,
    scope: str,
    horizon: int = DEFAULT_HORIZON,
    filters: dict | None = None,
    models: DataFrame | None = None,
) -> DataFrame:
    """As ``trend_forecast``, with a trend that bends."""
    wanted = known_filters(series, filters)
    if models is None:
        models = changepoint.fit_changepoint(wanted, scope)
    else:
        models = models.drop("last_ds").join(last_periods(wanted, scope), scope_keys(scope))
    return changepoint.forecast_changepoint(models, scope, horizon)


def tree_forecast(
    series: DataFrame,
    scope: str,
    params: trees.TreeParams,
    horizon: int = DEFAULT_HORIZON,
    filters: dict | None = None,
) -> DataFrame:
    """Fit on every key, forecast the wanted ones. Reads the series more than once: prepare it.

    The forecast is written, its trees are not: they are fitted on their way to the only place that reads them.
    """
    features = trees.train_rows(series, scope)
    model = trees.fit_trees(features, scope, params, False)
    per_key = trees.fit_keys(features, scope, params)
    forecast = trees.forecast_trees(known_filters(series, filters), per_key, model, scope, horizon)
    return written(forecast, "forecast")


def sequence_forecast(
    series: DataFrame,
    scope: str,
    horizon: int = DEFAULT_HORIZON,
    filters: dict | None = None,
    models: DataFrame | None = None,
) -> DataFrame:
    wanted = known_filters(series, filters)
    if models is None:
        models = sequence.fit_sequence(wanted, scope)
    return sequence.forecast_sequence(wanted, models, scope, horizon)


def nested_forecast(forecast: DataFrame, scope: str) -> DataFrame:
    """(key, forecast): one row per key with its months as an array, as long as the horizon."""
    month = F.struct(as_text_date(F.col("ds")).alias("ds"), "yhat", "yhat_lower", "yhat_upper")
    return (
        forecast.groupBy(*scope_keys(scope))
        .agg(F.sort_array(F.collect_list(month)).alias("forecast"))
        .withColumn("key", key_label(scope_keys(scope)))
    )

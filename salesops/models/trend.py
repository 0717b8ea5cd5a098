"""Trend with monthly seasonality, fitted and applied with built-in aggregates.

Stands in for an additive/multiplicative trend-seasonality forecaster. It keeps the capability,
not the numbers of a particular library: one straight trend (no changepoints), one effect per
calendar month (no Fourier terms), normal intervals (not sampled).

    t        months since January 2000
    trend    intercept + slope * t, least squares
    season   additive: mean of y - trend per calendar month
             multiplicative: mean of y / trend - 1 per calendar month
    sigma    sample deviation of y - fitted
    interval fitted -+ 1.2816 * sigma (80 %)

Seasonality needs a span of ``season_months``, two years by default: within one year a season
cannot be told from a trend. A calendar month never seen has no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.functions.params import check_range
from salesops.operators.series import by_key, keyed, month_index, next_months
from salesops.scopes import DEFAULT_HORIZON, scope_keys

MODES = ("additive", "multiplicative")
INTERVAL_80 = 1.2816
MIN_ROWS = 2
MONTHS_FOR_SEASON = 24


def _combine(trend: Column, season: Column, mode: Column) -> Column:
    return F.when(mode == "multiplicative", trend * (1 + season)).otherwise(trend + season)


def fitted_rows(
    series: DataFrame, scope: str, mode: str = "additive", season_months: int = MONTHS_FOR_SEASON
) -> DataFrame:
    """Series rows with the fit of their key beside them.

    All windows share the partitioning on the keys: one shuffle of monthly rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    key = by_key(scope)
    y, t = F.col("y"), F.col("t")
    rows = (
        keyed(series, scope)
        .dropna(subset=["y"])
        .withColumn("t", month_index(F.col("ds")).cast("double"))
        .withColumns(
            {
                "n_obs": F.count("*").over(key),
                "slope": F.regr_slope(y, t).over(key),
                "intercept": F.regr_intercept(y, t).over(key),
                "span": F.max(t).over(key) - F.min(t).over(key),
            }
        )
        .filter(F.col("n_obs") >= MIN_ROWS)
        .withColumn("trend", F.col("intercept") + F.col("slope") * t)
        .withColumn("month", F.month("ds"))
    )
    if mode == "multiplicative":
        effect = F.try_divide(y, F.col("trend")) - 1
    else:
        effect = y - F.col("trend")
    per_month = Window.partitionBy(*scope_keys(scope), "month")
    season = F.when(F.col("span") >= season_months, F.avg(effect).over(per_month))
    return (
        rows.withColumn("season", F.coalesce(season, F.lit(0.0)))
        .withColumn("yhat", _combine(F.col("trend"), F.col("season"), F.lit(mode)))
        .select(*scope_keys(scope), "ds", "y", "yhat", "month", "season", "intercept", "slope", "n_obs")
    )


def fit_trend(
    series: DataFrame, scope: str, mode: str = "additive", season_months: int = MONTHS_FOR_SEASON
) -> DataFrame:
    """One row per key: intercept, slope, seasonal (12 effects), sigma, n_obs, last_ds, mode."""
    effects = [F.coalesce(F.max(F.when(F.col("month") == m, F.col("season"))), F.lit(0.0)) for m in range(1, 13)]
    return (
        fitted_rows(series, scope, mode, season_months)
        .groupBy(*scope_keys(scope))
        .agg(
            F.max("intercept").alias("intercept"),
            F.max("slope").alias("slope"),
            F.array(*effects).alias("seasonal"),
            F.stddev_samp(F.col("y") - F.col("yhat")).alias("sigma"),
            F.count("*").alias("n_obs"),
            F.max("ds").alias("last_ds"),
        )
        .withColumn("mode", F.lit(mode))
    )


def predict_trend(rows: DataFrame) -> DataFrame:
    """Adds yhat and its interval to rows that hold ``ds`` and the columns of a fitted model."""
    trend = F.col("intercept") + F.col("slope") * month_index(F.col("ds"))
    season = F.element_at("seasonal", F.month("ds"))
    margin = F.col("sigma") * INTERVAL_80
    return rows.withColumn("yhat", _combine(trend, season, F.col("mode"))).withColumns(
        {"yhat_lower": F.col("yhat") - margin, "yhat_upper": F.col("yhat") + margin}
    )


def forecast_trend(models: DataFrame, scope: str, horizon: int = DEFAULT_HORIZON) -> DataFrame:
    """(keys, ds, yhat, yhat_lower, yhat_upper) for the months after each key's ``last_ds``."""
    check_range("horizon", horizon, 1)
    months = models.withColumn("ds", F.explode(next_months(F.col("last_ds"), horizon)))
    return predict_trend(months).select(*scope_keys(scope), "ds", "yhat", "yhat_lower", "yhat_upper")

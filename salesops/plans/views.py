"""Roll-ups of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesops.functions.params import missing_dims
from salesops.scopes import scope_keys, view_dims

BANDS = ("yhat", "yhat_lower", "yhat_upper")


def with_calendar(forecast: DataFrame) -> DataFrame:
    return forecast.withColumns({"Year": F.year("ds"), "Month": F.month("ds")})


def roll_up(forecast: DataFrame, dims: list[str]) -> DataFrame:
    """Forecast summed to the given dimensions; a NULL dimension value is a group."""
    return forecast.groupBy(*dims).agg(*[F.sum(b).alias(b) for b in BANDS])


def forecast_grid(forecast: DataFrame, scope: str, dimensions: list[str] | None = None) -> DataFrame:
    """Forecast per month and requested key dimension, with the dimensions it does not have.

    Every key is forecast by its own model first and then summed, so a coarse grid is complete.
    Without a usable dimension the scope's keys are taken.
    """
    keys = scope_keys(scope)
    asked = list(dimensions or keys)
    used = [d for d in asked if d in keys] or keys
    rows = with_calendar(forecast)
    missing = missing_dims(rows, asked)
    listed = F.array(*[F.lit(d) for d in missing]).cast("array<string>")
    return roll_up(rows, [*used, "ds", "Year", "Month"]).withColumn("missing_dims", listed)


def available_views(forecast: DataFrame, views: list[str] | None = None) -> dict[str, list[str]]:
    rows = with_calendar(forecast)
    return {v: dims for v, dims in view_dims(views).items() if not missing_dims(rows, dims)}


def view_status(forecast: DataFrame, views: list[str] | None = None) -> DataFrame:
    """(view, status, dimensions, missing_dims, measure, n_rows, total) of every requested view.

    ``n_rows`` and ``total`` tell how many rows the view has and what its forecasts add up to; an
    unavailable view has none.
    """
    rows = with_calendar(forecast)
    status = []
    for view, dims in view_dims(views).items():
        missing = missing_dims(rows, dims)
        status.append((view, "unavailable" if missing else "ok", dims, missing, "sales_amount"))
    schema = "view string, status string, dimensions array<string>, missing_dims array<string>, measure string"
    listed = forecast.sparkSession.createDataFrame(status, schema)
    sums = forecast_views(forecast, views).groupBy("view").agg(
        F.count("*").alias("n_rows"), F.sum("yhat").alias("total")
    )
    # One row per view on either side.
    return listed.join(F.broadcast(sums), "view", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def forecast_views(forecast: DataFrame, views: list[str] | None = None) -> DataFrame:
    """(view, Year, Month, Territory, Area, yhat, yhat_lower, yhat_upper) of all available views.

    The forecast is summed once to the finest level any view needs; one pass over grouping sets
    then gives every view. ``grouping`` flags tell a dimension a view does not have from a NULL
    key value.
    """
    wanted = available_views(forecast, views)
    rows = with_calendar(forecast)
    dims = [d for d in ("Year", "Month", "Territory", "Area") if d in rows.columns]
    layout = {d: rows.schema[d].dataType for d in dims}
    if not wanted:
        fields = [T.StructField("view", T.StringType())]
        fields += [T.StructField(d, layout[d]) for d in dims]
        fields += [T.StructField(b, T.DoubleType()) for b in BANDS]
        return forecast.sparkSession.createDataFrame([], T.StructType(fields))
    sets = [list(s) for s in dict.fromkeys(tuple(d) for d in wanted.values())]
    needed = [d for d in dims if any(d in s for s in sets)]
    finest = roll_up(rows, needed)
    grouped = finest.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in needed]).agg(
        *[F.grouping(d).alias(f"_no_{d}") for d in needed],
        *[F.sum(b).alias(b) for b in BANDS],
    )
    # A view is the set of its dimensions; views with equal dimensions repeat the rows.
    matches = []
    for view, own in wanted.items():
        fits = F.lit(True)
        for d in needed:
            fits = fits & (F.col(f"_no_{d}") == (0 if d in own else 1))
        matches.append(F.when(fits, F.lit(view)))
    named = grouped.withColumn("view", F.explode(F.array_compact(F.array(*matches))))
    absent = [F.lit(None).cast(layout[d]).alias(d) for d in dims if d not in needed]
    return named.select("view", *needed, *absent, *BANDS)

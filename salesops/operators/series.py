"""Monthly series per key and the features built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.functions import columns as C
from salesops.operators.joins import summed_by_place
from salesops.scopes import DEFAULT_LAGS, SURVEY_KEYS, scope_keys
from salesops.sources.tables import first_non_empty

# Accepted calendar years.
FIRST_YEAR, LAST_YEAR = 1900, 2100
# Keys that one task of per-key work gets, and the most tasks there are.
KEYS_PER_TASK = 8
MOST_TASKS = 2_000


def scope_series(
    survey: DataFrame, scope: str, measure: str = "revenue", places: DataFrame | None = None
) -> DataFrame:
    """(keys, Year, Month, SalesAmount): sums per key and period of the rows that have a period.

    ``measure`` is ``revenue`` (quantity times price, NULLs as 0) or ``qty``. With ``places`` the
    rows hold only their territory, and their sums meet the places.
    """
    if measure not in ("revenue", "qty"):
        raise ValueError(f"measure must be revenue or qty, not {measure!r}")
    amount = C.revenue_or_zero() if measure == "revenue" else C.quantity_or_zero()
    sources = [source for source, key in SURVEY_KEYS.items() if key in scope_keys(scope)]
    keys = {
        **{source: F.col(source) for source in sources},
        "Year": C.whole_number(survey, "YEAR_NO"),
        "Month": C.whole_number(survey, "MONTH_NO"),
    }
    sums = summed_by_place(_with_period(survey), places, keys, {"SalesAmount": amount})
    return sums.select(*C.key_columns(scope), "Year", "Month", "SalesAmount")


def _with_period(survey: DataFrame) -> DataFrame:
    return survey.filter(F.col("YEAR_NO").isNotNull() & F.col("MONTH_NO").isNotNull())


def aggregated_series(history: DataFrame, scope: str) -> DataFrame:
    """The same layout from a sales history that already holds amounts."""
    keys = scope_keys(scope)
    return (
        history.select(
            *keys,
            C.whole_number(history, "YEAR_NO").alias("Year"),
            C.whole_number(history, "MONTH_NO").alias("Month"),
            C.number("SalesAmount").alias("SalesAmount"),
        )
        .groupBy(*keys, "Year", "Month")
        .agg(F.sum("SalesAmount").alias("SalesAmount"))
    )


def sales_amounts(
    history: DataFrame | None,
    survey: DataFrame,
    scope: str,
    measure: str | None = None,
    probe: DataFrame | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """Sales history if it holds rows, else survey revenue, else survey quantity.

    ``measure`` forces one of the two survey forms. A history that is itself a grouping comes with
    its raw rows as ``probe``: one of them answers whether it holds any.
    """
    if measure is not None:
        return scope_series(survey, scope, measure, places)
    return first_non_empty(
        (history if probe is None else probe, lambda: aggregated_series(history, scope)),
        (_with_period(survey), lambda: scope_series(survey, scope, "revenue", places)),
        (None, lambda: scope_series(survey, scope, "qty", places)),
    )


def input_diagnostics(survey: DataFrame) -> DataFrame:
    """How many rows there are and how many of them have a period."""
    both = F.col("YEAR_NO").isNotNull() & F.col("MONTH_NO").isNotNull()
    return survey.agg(F.count("*").alias("rows_all"), F.count_if(both).alias("rows_with_period"))


def sanitize_period(df: DataFrame) -> DataFrame:
    """Keep rows with a whole Year in 1900..2100 and a whole Month in 1..12, both as integers."""
    numbers = df.withColumns({"Year": C.whole_number(df, "Year"), "Month": C.whole_number(df, "Month")})
    return numbers.filter(F.col("Year").between(FIRST_YEAR, LAST_YEAR) & F.col("Month").between(1, 12))


def monthly_series(amounts: DataFrame, scope: str) -> DataFrame:
    """(keys, ds, y) at month start. Unusable periods drop out.

    At most 201 * 12 rows per key, whatever the facts behind them: this bound is what
    makes the per-key windows and fits below safe.
    """
    clean = sanitize_period(amounts)
    return clean.select(
        *scope_keys(scope),
        C.month_start(F.col("Year"), F.col("Month")).alias("ds"),
        F.col("SalesAmount").alias("y"),
    )


def keyed(series: DataFrame, scope: str) -> DataFrame:
    """Rows with a complete key; a row with a NULL key part belongs to no model."""
    return series.dropna(subset=scope_keys(scope))


def dealt(series: DataFrame, scope: str, share: int = KEYS_PER_TASK) -> DataFrame:
    """Keys dealt out to tasks, a few for each, and in the same way on every cluster.

    For per-key work that costs far more than its few bytes suggest: adaptive execution would
    pack the keys by size into a handful of tasks. Reads the keys once to count them.
    """
    keys = scope_keys(scope)
    count = series.select(*keys).distinct().count()
    return series.repartition(min(-(-count // share), MOST_TASKS) or 1, *keys)


def by_key(scope: str) -> Window:
    return Window.partitionBy(*scope_keys(scope))


def lag_features(series: DataFrame, scope: str, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``lag_k``: the value k rows earlier. Missing months are not filled."""
    in_order = by_key(scope).orderBy("ds")
    return series.withColumns({f"lag_{k}": F.lag("y", k).over(in_order) for k in lags})


def calendar_features(series: DataFrame) -> DataFrame:
    return series.withColumns({"month": F.month("ds"), "year": F.year("ds")})


def training_features(series: DataFrame, scope: str, lags: tuple[int, ...] = DEFAULT_LAGS) -> DataFrame:
    """Lags and calendar of the rows where every column has a value."""
    return calendar_features(lag_features(keyed(series, scope), scope, lags)).dropna()


def feature_columns(features: DataFrame, scope: str) -> list[str]:
    reserved = {*scope_keys(scope), "ds", "y"}
    return [c for c in features.columns if c not in reserved]


def sequence_windows(series: DataFrame, scope: str, window: int = 12) -> DataFrame:
    """(keys, ds, x, y): the ``window`` previous values as an array and the value that followed."""
    known = keyed(series, scope).dropna(subset=["y"])
    before = by_key(scope).orderBy("ds").rowsBetween(-window, -1)
    return known.withColumn("x", F.collect_list("y").over(before)).filter(F.size("x") == window)


def last_periods(series: DataFrame, scope: str) -> DataFrame:
    return keyed(series, scope).groupBy(*scope_keys(scope)).agg(F.max("ds").alias("last_ds"))


def month_index(ds: Column) -> Column:
    """Months since January 2000, close to the data so that a line through it is well conditioned."""
    return (F.year(ds) - 2000) * 12 + F.month(ds) - 1


def next_months(last: Column, horizon: int) -> Column:
    """Array of the ``horizon`` month starts after ``last``."""
    return F.sequence(F.add_months(last, 1), F.add_months(last, horizon), F.expr("interval 1 month"))

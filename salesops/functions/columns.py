"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesops.scopes import SURVEY_KEYS, scope_keys

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType)


def whole_number(df: DataFrame, name: str) -> Column:
    """Integer of a period column: ``2023``, ``'2023'``, ``'02023'``, ``'2023.0'``; else NULL.

    An integer column passes through untouched, so filters on it still reach the scan.
    """
    column = F.col(name)
    if isinstance(df.schema[name].dataType, _INTEGRAL):
        return column.cast("int")
    number = column.try_cast("double")
    return F.when(number % 1 == 0, number.try_cast("int"))


def filterable_number(df: DataFrame, name: str) -> Column:
    """As ``whole_number`` for use in filters: an integral column of any width stays as it is,
    so that the filter reaches the scan or prunes partitions.
    """
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return F.col(name)
    return whole_number(df, name)


def number(name: str) -> Column:
    """64-bit float of a measure that may be stored as text or decimal."""
    return F.col(name).try_cast("double")


def revenue() -> Column:
    """Quantity times price; NULL when either is NULL."""
    return number("SALES_QTY") * number("UNIT_PRICE")


def revenue_or_zero() -> Column:
    zero = F.lit(0.0)
    return F.coalesce(number("SALES_QTY"), zero) * F.coalesce(number("UNIT_PRICE"), zero)


def quantity_or_zero() -> Column:
    return F.coalesce(number("SALES_QTY"), F.lit(0.0))


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent; NULL when the previous value is NULL or 0."""
    return F.when(previous != 0, (current - previous) / previous * 100.0)


def quarter_of(month: Column) -> Column:
    return F.floor((month + 2) / 3).cast("int")


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def key_columns(scope: str) -> list[Column]:
    """Survey id columns under their key names."""
    wanted = scope_keys(scope)
    return [F.col(source).alias(key) for source, key in SURVEY_KEYS.items() if key in wanted]


def key_label(keys: list[str]) -> Column:
    """Key values joined with ``__``; NULL parts are left out."""
    return F.concat_ws("__", *[F.col(k).cast("string") for k in keys])


def as_text_date(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def finite_or_null(column: Column) -> Column:
    """NaN as NULL, so that averages skip it."""
    return F.when(~F.isnan(column), column)

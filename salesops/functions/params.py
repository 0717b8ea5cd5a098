"""Parameter bounds and optional predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_range(name: str, value: int, low: int, high: int | None = None) -> int:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name}={value} is outside {low}..{'' if high is None else high}")
    return value


def typed_literal(df: DataFrame, name: str, value) -> Column:
    """The value in the column's own type, so that an equality reaches the scan uncast.

    Text that does not fit the type becomes NULL and matches no row.
    """
    return F.lit(value).try_cast(df.schema[name].dataType)


def equal_to(df: DataFrame, **wanted) -> list[Column]:
    """Equality per given column; ``None`` and ``""`` mean no filter."""
    return [
        F.col(name) == typed_literal(df, name, value)
        for name, value in wanted.items()
        if value is not None and value != ""
    ]


def contains_text(name: str, text: str | None, ignore_case: bool = False) -> list[Column]:
    """``LIKE '%text%'``; ``%`` and ``_`` inside the text keep their wildcard meaning."""
    if not text:
        return []
    column = F.col(name)
    return [column.ilike(f"%{text}%") if ignore_case else column.like(f"%{text}%")]


def within(column: Column, low=None, high=None) -> list[Column]:
    """Inclusive range; a missing bound is open."""
    preds = []
    if low is not None:
        preds.append(column >= F.lit(low))
    if high is not None:
        preds.append(column <= F.lit(high))
    return preds


def where_all(df: DataFrame, *predicate_lists: list[Column]) -> DataFrame:
    preds = [p for preds in predicate_lists for p in preds]
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def known_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """Equality filters on the columns the frame has; other names are ignored."""
    known = {k: v for k, v in (filters or {}).items() if k in df.columns}
    preds = [F.col(k) == typed_literal(df, k, v) for k, v in known.items()]
    return where_all(df, preds)


def missing_dims(df: DataFrame, dims: list[str]) -> list[str]:
    return [d for d in dims if d not in df.columns]

"""Grouping grains, forecast views and the fixed table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# Grain -> key columns, in hierarchy order.
SCOPES: dict[str, list[str]] = {
    "territory": ["Region", "Area", "Territory"],
    "area": ["Region", "Area"],
    "region": ["Region"],
}

# Survey column -> key column.
SURVEY_KEYS = {"REGION_ID": "Region", "AREA_ID": "Area", "TERRITORY_ID": "Territory"}

# Forecast view -> dimensions.
FORECAST_VIEWS: dict[str, list[str]] = {
    "yearly_total": ["Year"],
    "yearly_selected_product": ["Year", "Product"],
    "yearly_product_wise": ["Year", "Product"],
    "year_month_total": ["Year", "Month"],
    "year_month_selected_product": ["Year", "Month", "Product"],
    "year_month_product_wise": ["Year", "Month", "Product"],
    "year_month_territory_total": ["Year", "Month", "Territory"],
    "year_month_territory_selected_product": ["Year", "Month", "Territory", "Product"],
    "year_month_area_total": ["Year", "Month", "Area"],
    "year_month_area_selected_product": ["Year", "Month", "Area", "Product"],
}

DEFAULT_LAGS = (1, 2, 3, 6, 12)
DEFAULT_HORIZON = 6


def scope_keys(scope: str) -> list[str]:
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}, expected one of {sorted(SCOPES)}")
    return list(SCOPES[scope])


def view_dims(views: list[str] | None = None) -> dict[str, list[str]]:
    """Requested views with their dimensions, in the fixed order; all of them by default."""
    names = list(views) if views else list(FORECAST_VIEWS)
    unknown = [v for v in names if v not in FORECAST_VIEWS]
    if unknown:
        raise ValueError(f"unknown forecast views: {unknown}")
    return {v: dims for v, dims in FORECAST_VIEWS.items() if v in names}


SURVEY_SCHEMA = T.StructType(
    [
        T.StructField("ROW_DATA_ID", T.LongType()),
        T.StructField("SURVEY_CIRCLE_ID", T.StringType()),
        T.StructField("YEAR_NO", T.IntegerType()),
        T.StructField("MONTH_NO", T.IntegerType()),
        T.StructField("PRODUCT_ID", T.LongType()),
        T.StructField("SALES_QTY", T.DoubleType()),
        T.StructField("UNIT_PRICE", T.DoubleType()),
        T.StructField("TERRITORY_ID", T.LongType()),
        T.StructField("AREA_ID", T.LongType()),
        T.StructField("REGION_ID", T.LongType()),
        T.StructField("PRS_ID", T.StringType()),
    ]
)

PRODUCT_SCHEMA = T.StructType(
    [
        T.StructField("PRODUCT_ID", T.LongType()),
        T.StructField("PRODUCT_CODE", T.StringType()),
        T.StructField("PRODUCT_NAME", T.StringType()),
        T.StructField("DOSAGE_NAME", T.StringType()),
        T.StructField("PHARMA_NAME", T.StringType()),
        T.StructField("GENERIC_NAME", T.StringType()),
        T.StructField("UNIT_PRICE", T.DoubleType()),
    ]
)

MARKET_SCHEMA = T.StructType(
    [
        T.StructField("FIELD_ID", T.StringType()),
        T.StructField("MKT_NAME", T.StringType()),
        T.StructField("MKT_LEVEL", T.IntegerType()),
        T.StructField("PARENT_MKT_CODE", T.StringType()),
        T.StructField("MKT_CODE_OLD", T.StringType()),
    ]
)

SALES_HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("Region", T.LongType()),
        T.StructField("Area", T.LongType()),
        T.StructField("Territory", T.LongType()),
        T.StructField("YEAR_NO", T.IntegerType()),
        T.StructField("MONTH_NO", T.IntegerType()),
        T.StructField("SalesAmount", T.DoubleType()),
    ]
)

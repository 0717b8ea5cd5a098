from __future__ import annotations

import datetime

import pytest

from salesops.operators import series
from salesops.scopes import SALES_HISTORY_SCHEMA
from tests.conftest import plan, rows


def month(i: int) -> datetime.date:
    return datetime.date(2020 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def monthly(spark):
    """Region 1 skips a month and has a NULL, region 2 is short, the third has no key."""
    data = [(1, month(i), None if i == 4 else float(i)) for i in range(16) if i != 2]
    data += [(2, month(i), 5.0) for i in range(3)]
    data += [(None, month(0), 1.0)]
    return spark.createDataFrame(data, "Region int, ds date, y double")


def test_lags_are_row_based(monthly):
    found = {r["ds"]: r for r in series.lag_features(monthly.filter("Region = 1"), "region").collect()}
    # March is missing: April's previous row is February.
    assert found[month(3)]["lag_1"] == 1.0
    assert found[month(3)]["lag_2"] == 0.0
    assert found[month(5)]["lag_1"] is None
    assert found[month(0)]["lag_1"] is None


def test_training_rows_are_complete(monthly):
    features = series.training_features(monthly, "region")
    assert series.feature_columns(features, "region") == [
        "lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "month", "year",
    ]
    found = rows(features.select("Region", "ds", "lag_12", "month", "year"))
    # 15 rows: the first 12 lack lag 12; the NULL is out of reach of the rest.
    assert sorted(found) == [
        (1, month(13), 0.0, 2, 2021),
        (1, month(14), 1.0, 3, 2021),
        (1, month(15), 3.0, 4, 2021),
    ]


def test_windows_skip_unknown_values(monthly):
    found = rows(series.sequence_windows(monthly, "region", 3).select("Region", "ds", "x", "y"))
    values = [float(i) for i in range(16) if i not in (2, 4)]
    assert sorted(r[3] for r in found) == values[3:]
    assert all(r[2] == values[values.index(r[3]) - 3 : values.index(r[3])] for r in found)


def test_last_period(monthly):
    assert sorted(rows(series.last_periods(monthly, "region"))) == [(1, month(15)), (2, month(2))]


@pytest.fixture(scope="module")
def survey(spark):
    return spark.createDataFrame(
        [
            (1, "2023", "1", 2.0, 5.0),
            (1, "2023.0", "01", 1.0, None),
            (1, "2023", "13", 1.0, 1.0),
            (1, "1899", "1", 1.0, 1.0),
            (1, "2101", "1", 1.0, 1.0),
            (1, "2023", "0", 1.0, 1.0),
            (1, "x", "1", 1.0, 1.0),
            (1, None, "1", 1.0, 1.0),
            (None, "2023", "2", None, 3.0),
        ],
        "REGION_ID int, YEAR_NO string, MONTH_NO string, SALES_QTY double, UNIT_PRICE double",
    )


def test_series_from_facts(survey):
    revenue = series.monthly_series(series.scope_series(survey, "region"), "region")
    assert sorted(rows(revenue), key=repr) == [
        (1, datetime.date(2023, 1, 1), 10.0),
        (None, datetime.date(2023, 2, 1), 0.0),
    ]
    qty = series.monthly_series(series.scope_series(survey, "region", "qty"), "region")
    assert (1, datetime.date(2023, 1, 1), 3.0) in rows(qty)
    with pytest.raises(ValueError):
        series.scope_series(survey, "region", "price")
    with pytest.raises(ValueError):
        series.scope_series(survey, "shop")


def test_diagnostics(survey):
    assert rows(series.input_diagnostics(survey)) == [(9, 8)]
    assert rows(series.input_diagnostics(survey.filter("false"))) == [(0, 0)]


def test_fallback_order(spark, survey):
    empty = spark.createDataFrame([], SALES_HISTORY_SCHEMA)
    history = spark.createDataFrame([(1, 1, 1, 2023, 1, 99.0), (1, 1, 2, 2023, 1, 1.0)], SALES_HISTORY_SCHEMA)
    assert rows(series.sales_amounts(history, survey, "region")) == [(1, 2023, 1, 100.0)]
    for missing in (None, empty):
        found = rows(series.sales_amounts(missing, survey, "region").filter("Year = 2023 AND Month = 1"))
        assert found == [(1, 2023, 1, 10.0)]
    forced = rows(series.sales_amounts(history, survey, "region", "qty").filter("Year = 2023 AND Month = 1"))
    assert forced == [(1, 2023, 1, 3.0)]
    nothing = series.sales_amounts(None, survey.filter("YEAR_NO IS NULL"), "region")
    assert nothing.count() == 0


def test_one_sort_serves_all_lags(monthly):
    text = plan(series.lag_features(monthly, "region", (1, 2, 3, 6, 12)))
    assert text.count("Window") == 1 and text.count("Exchange") == 1

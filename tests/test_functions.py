from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from salesops.functions import columns as C
from salesops.functions import params as P
from salesops.scopes import scope_keys, view_dims
from tests.conftest import plan, rows


def test_whole_number_of_text(spark):
    texts = ["2023", "02023", "2023.0", "x", None, "", "20.5", "NaN", "Infinity", "99999999999", "-3"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    found = [r[0] for r in rows(df.select(C.whole_number(df, "p")))]
    assert found == [2023, 2023, 2023, None, None, None, None, None, None, None, -3]


def test_whole_number_of_other_types(spark):
    df = spark.sql("SELECT 7 AS i, 7L AS l, 7.0D AS d, 7.5D AS half, CAST(7.00 AS DECIMAL(9,2)) AS m")
    assert rows(df.select(*[C.whole_number(df, c) for c in df.columns])) == [(7, 7, 7, None, 7)]


def test_pct_change_guards(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 0.0), (2.0, None), (None, 1.0)], "now double, was double")
    found = rows(df.select(C.pct_change(F.col("now"), F.col("was"))))
    assert found == [(100.0,), (None,), (None,), (None,)]


def test_revenue_forms_differ_on_null(spark):
    df = spark.createDataFrame([(2.0, None), (None, 3.0), (2.0, 3.0)], "SALES_QTY double, UNIT_PRICE double")
    assert rows(df.select(C.revenue(), C.revenue_or_zero())) == [(None, 0.0), (None, 0.0), (6.0, 6.0)]


def test_quarters_and_dates(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    quarters = [r[0] for r in rows(df.orderBy("m").select(C.quarter_of(F.col("m"))))]
    assert quarters == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]
    start = df.filter("m = 2").select(C.month_start(F.lit(2024), F.col("m")))
    assert rows(start) == [(datetime.date(2024, 2, 1),)]


def test_key_label_skips_null(spark):
    df = spark.createDataFrame([(1, None, 3)], "a int, b int, c int")
    assert rows(df.select(C.key_label(["a", "b", "c"]))) == [("1__3",)]


def test_bounds():
    assert P.check_range("limit", 5, 1, 5) == 5
    for value in (0, 6):
        with pytest.raises(ValueError):
            P.check_range("limit", value, 1, 5)
    with pytest.raises(ValueError):
        scope_keys("country")
    with pytest.raises(ValueError):
        view_dims(["weekly_total"])


def test_optional_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    assert P.where_all(df, P.equal_to(df, n=None, s="")).count() == 3
    assert rows(P.where_all(df, P.equal_to(df, n="2"))) == [(2, "b")]
    assert P.where_all(df, P.equal_to(df, n="two")).count() == 0
    assert P.where_all(df, P.within(F.col("n"), 2, None)).count() == 2
    assert P.where_all(df, P.within(F.col("n"), 2, 2)).count() == 1


def test_contains_keeps_wildcards(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("AXB",)], "s string")
    assert P.where_all(df, P.contains_text("s", "a_b")).count() == 2
    assert P.where_all(df, P.contains_text("s", "a_b", ignore_case=True)).count() == 3


def test_known_filters_ignore_other_names(spark):
    df = spark.createDataFrame([(1,), (2,)], "Region int")
    assert P.known_filters(df, {"Region": 1, "Shelf": 4}).count() == 1
    assert P.known_filters(df, None).count() == 2


def test_text_parameter_reaches_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    wanted = P.where_all(df, P.equal_to(df, l_suppkey="3"))
    assert "EqualTo(l_suppkey,3)" in plan(wanted)

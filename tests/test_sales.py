from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesops.operators import joins, product, quantiles, sales, series
from salesops.sources import starschema as star
from salesops.scopes import PRODUCT_SCHEMA, SURVEY_SCHEMA
from tests.conftest import plan, rows

COLUMNS = "ROW_DATA_ID long, YEAR_NO string, MONTH_NO string, PRODUCT_ID long, SALES_QTY string, UNIT_PRICE double"


@pytest.fixture(scope="module")
def survey(spark):
    return spark.createDataFrame(
        [
            (1, "2023", "1", 10, "2", 5.0),
            (2, "02023", "1", 10, "3", 7.0),
            (3, "2023", "2", 10, None, 0.0),
            (4, "2023", "3", 10, "1", 4.0),
            (5, "2024", "1", 20, "-1", None),
            (6, None, "1", 20, "4", 2.0),
        ],
        COLUMNS,
    )


def test_text_years_of_one_value_share_a_group(survey):
    found = rows(sales.monthly_trend(survey))
    assert found == [
        (None, 1, 4.0, 8.0),
        (2023, 1, 5.0, 31.0),
        (2023, 2, None, None),
        (2023, 3, 1.0, 4.0),
        (2024, 1, -1.0, None),
    ]


def test_price_change(survey):
    found = rows(sales.price_change_mom(survey, product_id="10"))
    assert found == [(10, 2023, 1, 6.0, None), (10, 2023, 2, 0.0, -100.0), (10, 2023, 3, 4.0, None)]


def test_price_change_limits_products_by_months(survey):
    found = rows(sales.price_change_mom(survey, limit_products=1).select("PRODUCT_ID").distinct())
    assert found == [(10,)]
    assert sales.price_change_mom(survey, start_year=2024, end_year=2024).count() == 1
    with pytest.raises(ValueError):
        sales.price_change_mom(survey, limit_products=0)


def test_price_change_reads_the_facts_once(spark, small):
    text = plan(sales.price_change_mom(star.quality_lines(spark, small)))
    assert "lineitem" not in text and text.count("monthly-prices") == text.count("FileScan") == 2
    assert "TakeOrderedAndProject" in text


def test_ranked_lists_do_not_sort_everything(spark, small):
    lines = star.quality_lines(spark, small)
    for df in (sales.top_products(lines), sales.sales_sample(lines), sales.time_features(lines)):
        assert "TakeOrderedAndProject" in plan(df)


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_period_filters_reach_the_scan(spark, small, tmp_path, kind, monkeypatch):
    lines = star.quality_lines(spark, small).withColumns(
        {"YEAR_NO": F.col("YEAR_NO").cast(kind), "MONTH_NO": F.col("MONTH_NO").cast(kind)}
    )
    lines.write.partitionBy("YEAR_NO").parquet(str(tmp_path / "survey"))
    stored = spark.read.schema(lines.schema).parquet(str(tmp_path / "survey"))
    text = plan(sales.top_products(stored, year=1998, month=5))
    assert "(YEAR_NO#" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "EqualTo(MONTH_NO,5)" in text
    assert rows(sales.top_products(stored, 1998, 5)) == rows(sales.top_products(lines, 1998, 5))
    monkeypatch.setattr(sales, "written", lambda df, name: df)
    text = plan(sales.price_change_mom(stored, start_year=1997, end_year=1998))
    assert "(YEAR_NO#" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_only_needed_columns_are_read(spark, small):
    text = plan(sales.time_coverage(star.quality_lines(spark, small)))
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in text


def test_summary_stats(survey):
    row = sales.sales_summary_stats(survey).first()
    assert (row["row_count"], row["qt_nulls"], row["qt_neg_count"], row["price_nulls"]) == (6, 1, 1, 1)
    assert (row["qt_min"], row["qt_max"], row["price_neg_count"]) == (-1.0, 4.0, 0)
    assert row["qt_mean"] == pytest.approx(1.8)


def test_empty_survey(spark):
    empty = spark.createDataFrame([], SURVEY_SCHEMA)
    assert sales.sales_summary(empty).first()["row_count"] == 0
    assert sales.sales_summary_stats(empty).first()["qt_nulls"] == 0
    assert rows(sales.price_quantity_corr(empty)) == [(0, None)]
    assert rows(sales.sales_distribution(empty).select("count")) == [(0,), (0,)]
    assert sales.time_coverage(empty).count() == 0
    assert sales.sales_value_counts(empty).count() == 0


def test_correlation(spark):
    def corr(pairs, **options):
        data = [(i, p, q) for i, (p, q) in enumerate(pairs)]
        df = spark.createDataFrame(data, "ROW_DATA_ID int, UNIT_PRICE double, SALES_QTY double")
        return rows(sales.price_quantity_corr(df, **options))[0]

    assert corr([(1.0, 2.0)]) == (1, None)
    assert corr([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)]) == (3, None)
    assert corr([(1.0, 2.0), (2.0, 4.0), (None, 1.0)])[1] == pytest.approx(1.0)
    many = [(float(i), float(-i)) for i in range(50)] + [(float(i), float(i)) for i in range(100)]
    n, newest = corr(many, sample=100)
    assert n == 100 and newest == pytest.approx(1.0)


def test_distribution_sample_takes_the_newest(spark):
    df = spark.createDataFrame(
        [(i, float(i), None if i > 6 else 1.0) for i in range(10)], "ROW_DATA_ID int, SALES_QTY double, UNIT_PRICE double"
    )
    found = {r["column"]: r for r in sales.sales_distribution(df, sample_limit=3).collect()}
    assert (found["SALES_QTY"]["min"], found["SALES_QTY"]["median"], found["SALES_QTY"]["count"]) == (7.0, 8.0, 3)
    assert found["UNIT_PRICE"]["count"] == 3
    approx = {r["column"]: r for r in sales.sales_distribution(df, approx=True).collect()}
    assert approx["SALES_QTY"]["max"] == 9.0


def test_rolling_window(spark):
    data = [(1, 2020, m, float(m)) for m in (1, 2, 3, 5)]
    df = spark.createDataFrame(data, "REGION_ID int, YEAR_NO int, MONTH_NO int, SALES_QTY double")
    found = [r["rolling_avg_qty"] for r in sales.rolling_qty(df, 2, region_id="1").collect()]
    assert found == [1.0, 1.5, 2.5, 4.0]
    assert sales.rolling_qty(df, 2, region_id="2").count() == 0
    with pytest.raises(ValueError):
        sales.rolling_qty(df, 13)


def test_time_coverage(survey):
    assert rows(sales.time_coverage(survey)) == [
        ("year", None, 1),
        ("year", 2023, 4),
        ("year", 2024, 1),
        ("month", 1, 4),
        ("month", 2, 1),
        ("month", 3, 1),
    ]


def test_results_do_not_depend_on_partitions(spark, small):
    lines = star.quality_lines(spark, small)
    for n in (1, 13):
        shuffled = lines.repartition(n)
        assert rows(sales.top_products(shuffled).select("PRODUCT_ID")) == rows(
            sales.top_products(lines).select("PRODUCT_ID")
        )
        assert rows(sales.time_coverage(shuffled)) == rows(sales.time_coverage(lines))


def test_places_by_salted_join(spark, small):
    lines, places = star.quality_lines(spark, small), star.places(spark, small)
    salted = joins.lookup_join(lines, places, "TERRITORY_ID", max_broadcast_rows=0)
    expected = rows(sales.region_summary(star.survey_quality(spark, small)).select("TERRITORY_ID", "total_qty"))
    assert rows(sales.region_summary(salted).select("TERRITORY_ID", "total_qty")) == expected


def test_lines_are_summed_before_they_meet_their_places(spark, small):
    lines, places = star.quality_lines(spark, small), star.places(spark, small)
    whole = star.survey_quality(spark, small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for operator, options in (
            (sales.region_summary, {}),
            (sales.monthly_trend, {"region_id": "2"}),
            (sales.rolling_qty, {}),
            (sales.region_avg_price, {}),
            (series.scope_series, {"scope": "area"}),
        ):
            apart = operator(lines, places=places, **options)
            text = plan(apart)
            assert text.count("lineitem.parquet") == 1
            above = text[: text.index("lineitem.parquet")]
            assert "partial_sum" in above[above.rindex("Join") :]
            found = [[round(v, 4) if isinstance(v, float) else v for v in r] for r in rows(apart)]
            expected = [[round(v, 4) if isinstance(v, float) else v for v in r] for r in rows(operator(whole, **options))]
            assert sorted(found, key=repr) == sorted(expected, key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(sales.sales_summary(lines, places=places)) == rows(sales.sales_summary(whole))


def test_only_the_newest_lines_are_joined(spark, small):
    lines = star.circle_lines(spark, small)
    text = plan(sales.sales_sample(lines, 5, lambda newest: star.with_circle(newest, small)))
    assert text.index("Join") < text.rindex("TakeOrderedAndProject")


@pytest.mark.parametrize("least", [1, 40])
def test_quantiles_of_a_narrow_band_beside_an_outlier(spark, monkeypatch, least):
    """All but one value fall into one cell of the first histogram; it is divided until it is small."""
    monkeypatch.setattr(quantiles, "ORDERED_VALUES", least)
    monkeypatch.setattr(quantiles, "CELLS", 16)
    values = [1e300] + [1.0 + i * 1e-9 for i in range(3000)] + [5.0] * 700 + [-3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = quantiles.exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.9, 1.0]).first()
    assert found["quantiles"] == pytest.approx(list(np.quantile(values, [0.0, 0.1, 0.5, 0.9, 1.0])), rel=1e-15)


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame(
        [
            (1, "P1", "Alpha", "Tab", "Acme", "Para", 5.0),
            (2, "P2", "Beta", "Tab", "ACME", "Para", 9.5),
            (3, "P3", "Alphabet", None, "Acme", "Ibu", None),
        ],
        PRODUCT_SCHEMA,
    )


def test_product_search(master):
    def ids(**options):
        return [r["PRODUCT_ID"] for r in product.product_search(master, **options).collect()]

    assert ids() == [1, 3, 2]
    assert ids(product_name="lph") == [1, 3]
    assert ids(pharma_name="Acme") == [1, 3]
    assert ids(pharma_name="acme", ignore_case=True) == [1, 3, 2]
    assert ids(min_price=5.0, max_price=9.0) == [1]
    assert ids(pharma_name="") == [1, 3, 2]
    assert ids(limit=1) == [1]
    with pytest.raises(ValueError):
        ids(min_price=-1.0)


def test_product_price_stats(spark, master):
    row = product.product_price_stats(master).first()
    assert (row["n"], row["nulls"], row["q1"], row["median"], row["q3"]) == (3, 1, 6.125, 7.25, 8.375)
    empty = product.product_price_stats(spark.createDataFrame([], PRODUCT_SCHEMA)).first()
    assert (empty["n"], empty["median"]) == (0, None)
    assert product.product_price_stats(master, sample_limit=1).first()["median"] == 5.0


def test_generic_dosage(master):
    assert rows(product.generic_dosage(master)) == [("Para", "Tab", 2), ("Ibu", None, 1)]

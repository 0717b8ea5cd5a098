"""Exploratory queries over the survey fact."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.functions import columns as C
from salesops.functions.params import check_range, equal_to, where_all, within
from salesops.operators import quality
from salesops.operators.joins import summed_by_place
from salesops.operators.quantiles import approximate_quantiles, exact_quantiles
from salesops.plans.lineage import written
from salesops.sources.tables import newest_rows

# Id columns, columns of a sample, columns of a place.
ID_COLUMNS = ["PRODUCT_ID", "SURVEY_CIRCLE_ID", "TERRITORY_ID", "AREA_ID", "REGION_ID"]
SAMPLE_COLUMNS = [
    "ROW_DATA_ID",
    "SURVEY_CIRCLE_ID",
    "YEAR_NO",
    "MONTH_NO",
    "PRODUCT_ID",
    "SALES_QTY",
    "UNIT_PRICE",
    "TERRITORY_ID",
    "AREA_ID",
    "REGION_ID",
    "PRS_ID",
]
PLACE_IDS = ["REGION_ID", "AREA_ID", "TERRITORY_ID"]


def _measures() -> dict[str, Column]:
    return {"total_qty": C.number("SALES_QTY"), "sales_amount": C.revenue()}


def _totals() -> list:
    return [F.sum(c).alias(n) for n, c in _measures().items()]


def _months(survey: DataFrame) -> dict[str, Column]:
    return {c: C.whole_number(survey, c) for c in ("YEAR_NO", "MONTH_NO")}


def _period(df: DataFrame, year: int | None, month: int | None) -> list:
    preds = []
    if year is not None:
        preds.append(C.filterable_number(df, "YEAR_NO") == year)
    if month is not None:
        preds.append(C.filterable_number(df, "MONTH_NO") == month)
    return preds


def sales_summary(survey: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Row count, year range and distinct ids.

    Rows are counted by product and territory first: the distinct ids follow from these groups,
    and so do the areas and regions, from the places of the distinct territories.
    """
    year = C.whole_number(survey, "YEAR_NO")
    place_columns = ["TERRITORY_ID"] if places is not None else PLACE_IDS
    groups = written(
        survey.groupBy("PRODUCT_ID", *place_columns).agg(
            F.count("*").alias("n"), F.min(year).alias("min_year"), F.max(year).alias("max_year")
        ),
        "sales-groups",
    )
    located = groups.select(*place_columns).distinct()
    if places is not None:
        located = located.join(places, "TERRITORY_ID")
    counts = located.agg(
        F.count_distinct("REGION_ID").alias("region_count"),
        F.count_distinct("AREA_ID").alias("area_count"),
        F.count_distinct("TERRITORY_ID").alias("territory_count"),
        F.lit(1).alias("_one"),
    )
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.min("min_year").alias("min_year"),
        F.max("max_year").alias("max_year"),
        F.count_distinct("PRODUCT_ID").alias("product_count"),
        F.lit(1).alias("_one"),
    )
    # Two one-row frames side by side.
    return totals.join(F.broadcast(counts), "_one").drop("_one")


def region_summary(
    survey: DataFrame, year: int | None = None, month: int | None = None, places: DataFrame | None = None
) -> DataFrame:
    wanted = where_all(survey, _period(survey, year, month))
    found = summed_by_place(wanted, places, {c: F.col(c) for c in PLACE_IDS}, _measures())
    return found.select(*PLACE_IDS, *_measures()).orderBy(*PLACE_IDS)


def monthly_trend(
    survey: DataFrame,
    region_id=None,
    area_id=None,
    territory_id=None,
    product_id=None,
    places: DataFrame | None = None,
) -> DataFrame:
    """Totals per month. With ``places`` the region and area are looked for there."""
    located = equal_to(
        survey if places is None else places, REGION_ID=region_id, AREA_ID=area_id, TERRITORY_ID=territory_id
    )
    wanted = where_all(survey, equal_to(survey, PRODUCT_ID=product_id))
    if places is None:
        wanted = where_all(wanted, located)
    else:
        places = where_all(places, located)
    return summed_by_place(wanted, places, _months(survey), _measures()).orderBy("YEAR_NO", "MONTH_NO")


def top_products(
    survey: DataFrame,
    year: int | None = None,
    month: int | None = None,
    region_id=None,
    area_id=None,
    territory_id=None,
    limit: int = 10,
) -> DataFrame:
    """Products with the highest revenue; equal revenue is ordered by PRODUCT_ID."""
    check_range("limit", limit, 1, 200)
    places = equal_to(survey, REGION_ID=region_id, AREA_ID=area_id, TERRITORY_ID=territory_id)
    wanted = where_all(survey, _period(survey, year, month), places)
    products = wanted.groupBy("PRODUCT_ID").agg(*_totals())
    return products.orderBy(F.desc("sales_amount"), "PRODUCT_ID").limit(limit)


def sales_sample(
    survey: DataFrame, limit: int = 50, attach: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Newest rows; rows of one ROW_DATA_ID are ordered by the columns that tell them apart.

    ``attach`` adds columns to the rows that were picked, so that no join sees the others.
    """
    check_range("limit", limit, 1, 500)
    order = [F.desc("ROW_DATA_ID"), "PRODUCT_ID", "TERRITORY_ID", "SALES_QTY", "UNIT_PRICE"]
    newest = survey.orderBy(*order).limit(limit)
    found = attach(newest) if attach else newest
    present = [c for c in SAMPLE_COLUMNS if c in found.columns]
    return found.select(*present).orderBy(*order)


def sales_summary_stats(survey: DataFrame) -> DataFrame:
    """NULLs, range, mean, sample deviation and negatives of quantity and price in one pass."""
    measures = []
    for prefix, name in (("qt", "SALES_QTY"), ("price", "UNIT_PRICE")):
        value = C.number(name)
        measures += [
            F.count_if(F.col(name).isNull()).alias(f"{prefix}_nulls"),
            F.min(value).alias(f"{prefix}_min"),
            F.max(value).alias(f"{prefix}_max"),
            F.avg(value).alias(f"{prefix}_mean"),
            F.stddev_samp(value).alias(f"{prefix}_std"),
            F.count_if(value < 0).alias(f"{prefix}_neg_count"),
        ]
    return survey.agg(F.count("*").alias("row_count"), *measures)


def time_features(survey: DataFrame, sample: int = 5000) -> DataFrame:
    """Year, month and quarter of the newest rows that have a period."""
    check_range("sample", sample, 100, 200_000)
    month = C.whole_number(survey, "MONTH_NO")
    return (
        survey.filter(F.col("YEAR_NO").isNotNull() & F.col("MONTH_NO").isNotNull())
        .select(
            C.whole_number(survey, "YEAR_NO").alias("YEAR_NO"),
            month.alias("MONTH_NO"),
            C.quarter_of(month).alias("quarter"),
        )
        .orderBy(F.desc("YEAR_NO"), F.desc("MONTH_NO"))
        .limit(sample)
    )


def price_change_mom(
    survey: DataFrame,
    product_id=None,
    start_year: int | None = None,
    end_year: int | None = None,
    limit_products: int = 200,
) -> DataFrame:
    """Average monthly price and its change in percent for the products with most months.

    The monthly prices are written once: their number per product picks the products, and a semi
    join with at most ``limit_products`` of them picks their rows.
    """
    check_range("limit_products", limit_products, 1, 5000)
    years = within(C.filterable_number(survey, "YEAR_NO"), start_year, end_year)
    wanted = where_all(survey, equal_to(survey, PRODUCT_ID=product_id), years)
    monthly = wanted.groupBy(
        "PRODUCT_ID", *[c.alias(n) for n, c in _months(survey).items()]
    ).agg(F.avg(C.number("UNIT_PRICE")).alias("monthly_price"))
    monthly = written(monthly, "monthly-prices")
    counted = monthly.groupBy("PRODUCT_ID").agg(F.count("*").alias("n_months"))
    top = counted.orderBy(F.desc("n_months"), "PRODUCT_ID").limit(limit_products).select("PRODUCT_ID")
    # A missing product is a group like others, so the match treats NULL as a value.
    chosen = monthly.alias("m").join(
        F.broadcast(top.alias("t")), F.col("m.PRODUCT_ID").eqNullSafe(F.col("t.PRODUCT_ID")), "left_semi"
    )
    in_order = Window.partitionBy("PRODUCT_ID").orderBy("YEAR_NO", "MONTH_NO")
    previous = F.lag("monthly_price").over(in_order)
    return (
        chosen.withColumn("previous", previous)
        .withColumn("pct_change", C.pct_change(F.col("monthly_price"), F.col("previous")))
        .drop("previous")
        .orderBy("PRODUCT_ID", "YEAR_NO", "MONTH_NO")
    )


def rolling_qty(
    survey: DataFrame, window: int = 3, region_id=None, places: DataFrame | None = None
) -> DataFrame:
    """Mean of the monthly quantity over the last ``window`` monthly rows of a region."""
    check_range("window", window, 2, 12)
    located = equal_to(survey if places is None else places, REGION_ID=region_id)
    if places is None:
        survey = where_all(survey, located)
    else:
        places = where_all(places, located)
    keys = {"REGION_ID": F.col("REGION_ID"), **_months(survey)}
    monthly = summed_by_place(survey, places, keys, {"total_qty": C.number("SALES_QTY")})
    recent = Window.partitionBy("REGION_ID").orderBy("YEAR_NO", "MONTH_NO").rowsBetween(1 - window, 0)
    return monthly.withColumn("rolling_avg_qty", F.avg("total_qty").over(recent)).orderBy(
        "REGION_ID", "YEAR_NO", "MONTH_NO"
    )


def sales_distribution(
    survey: DataFrame, sample_limit: int | None = None, approx: bool = False
) -> DataFrame:
    """Range, quartiles, interquartile range and 99th percentile of quantity and price.

    Over all rows; ``sample_limit`` restricts each column to its newest non-NULL rows.
    """
    probabilities = [0.25, 0.5, 0.75, 0.99]
    columns = ["SALES_QTY", "UNIT_PRICE"]
    quantiles = approximate_quantiles if approx else exact_quantiles
    if sample_limit is None:
        found = quantiles(survey, columns, probabilities)
    else:
        samples = [
            quantiles(newest_rows(survey.filter(F.col(c).isNotNull()), sample_limit), [c], probabilities)
            for c in columns
        ]
        found = samples[0].unionByName(samples[1])
    q = F.col("quantiles")
    return found.select(
        "column",
        F.col("n").alias("count"),
        "min",
        q[0].alias("q1"),
        q[1].alias("median"),
        q[2].alias("q3"),
        "max",
        (q[2] - q[0]).alias("iqr"),
        q[3].alias("p99"),
    )


def sales_value_counts(
    survey: DataFrame, top_n: int = 50, lookups: dict[str, DataFrame] | None = None
) -> DataFrame:
    """The most frequent values of every id column.

    ``lookups`` names, by the column they are joined on, tables that hold further ids: rows are
    counted by that column first, and the counts meet the table.
    """
    own = [c for c in ID_COLUMNS if c in survey.columns]
    others = lookups or {}
    counted = quality.column_counts(survey, [*own, *[on for on in others if on not in own]])
    parts = [counted.filter(F.col("column").isin(own))]
    for on, lookup in others.items():
        ids = [c for c in ID_COLUMNS if c in lookup.columns and c not in own]
        here = counted.filter(F.col("column") == on).select(F.col("value").alias("_value"), "cnt")
        named = lookup.select(F.col(on).cast("string").alias("_value"), *[F.col(c).cast("string") for c in ids])
        wide = here.join(named, "_value").unpivot(["cnt"], ids, "column", "value")
        parts.append(wide.groupBy("column", "value").agg(F.sum("cnt").alias("cnt")))
    return quality.most_frequent(reduce(DataFrame.unionByName, parts), top_n)


def time_coverage(survey: DataFrame) -> DataFrame:
    """(grain, period, cnt): rows per year and rows per calendar month.

    Rows are counted per (year, month) first; both groupings then read that handful of rows.
    """
    per_month = survey.groupBy(
        C.whole_number(survey, "YEAR_NO").alias("YEAR_NO"),
        C.whole_number(survey, "MONTH_NO").alias("MONTH_NO"),
    ).agg(F.count("*").alias("cnt"))
    year, month = F.col("YEAR_NO"), F.col("MONTH_NO")
    is_month = F.grouping("YEAR_NO") == 1
    return (
        per_month.groupingSets([[year], [month]], year, month)
        .agg(is_month.alias("is_month"), F.sum("cnt").alias("cnt"))
        .select(
            F.when(F.col("is_month"), "month").otherwise("year").alias("grain"),
            F.when(F.col("is_month"), month).otherwise(year).alias("period"),
            "cnt",
        )
        .orderBy(F.desc("grain"), "period")
    )


def price_quantity_corr(survey: DataFrame, sample: int | None = None) -> DataFrame:
    """Pearson correlation of price and quantity with the number of pairs.

    NULL for fewer than two pairs or a constant column. Over all pairs, or over the ``sample``
    newest ones.
    """
    if sample is not None:
        check_range("sample", sample, 100, 200_000)
    price, qty = C.number("UNIT_PRICE"), C.number("SALES_QTY")
    pairs = newest_rows(survey.filter(price.isNotNull() & qty.isNotNull()), sample)
    deviations = F.stddev_samp(price) * F.stddev_samp(qty)
    corr = F.try_divide(F.covar_samp(price, qty), deviations)
    return pairs.agg(F.count("*").alias("sample"), corr.alias("corr"))


def region_avg_price(survey: DataFrame, top_n: int = 200, places: DataFrame | None = None) -> DataFrame:
    check_range("top_n", top_n, 1, 1000)
    price = C.number("UNIT_PRICE")
    sums = {"total": price, "priced": F.when(price.isNotNull(), 1).otherwise(0), "n": F.lit(1)}
    regions = summed_by_place(survey, places, {"REGION_ID": F.col("REGION_ID")}, sums)
    average = F.try_divide("total", "priced").alias("avg_price")
    return regions.select("REGION_ID", average, "n").orderBy(F.desc("avg_price"), "REGION_ID").limit(top_n)

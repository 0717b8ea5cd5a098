"""Queries over the product master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.functions import columns as C
from salesops.functions.params import check_range, contains_text, equal_to, where_all, within
from salesops.operators import quality
from salesops.operators.quantiles import approximate_quantiles, exact_quantiles
from salesops.plans.lineage import written

# Columns of the master, its texts and its categories.
MASTER_COLUMNS = [
    "PRODUCT_ID",
    "PRODUCT_CODE",
    "PRODUCT_NAME",
    "DOSAGE_NAME",
    "PHARMA_NAME",
    "GENERIC_NAME",
    "UNIT_PRICE",
]
TEXT_COLUMNS = ["PRODUCT_CODE", "PRODUCT_NAME", "PHARMA_NAME", "GENERIC_NAME", "DOSAGE_NAME"]
CATEGORY_COLUMNS = ["PHARMA_NAME", "GENERIC_NAME", "DOSAGE_NAME"]


def product_summary(product: DataFrame) -> DataFrame:
    price = C.number("UNIT_PRICE")
    return product.agg(
        F.count("*").alias("product_count"),
        F.count_distinct("PHARMA_NAME").alias("pharma_count"),
        F.count_distinct("GENERIC_NAME").alias("generic_count"),
        F.count_distinct("DOSAGE_NAME").alias("dosage_count"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.avg(price).alias("avg_price"),
    )


def product_search(
    product: DataFrame,
    pharma_name: str | None = None,
    generic_name: str | None = None,
    dosage_name: str | None = None,
    product_name: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    limit: int = 100,
    ignore_case: bool = False,
) -> DataFrame:
    """Products that meet every given condition, first ``limit`` by name."""
    check_range("limit", limit, 1, 1000)
    for name, bound in (("min_price", min_price), ("max_price", max_price)):
        if bound is not None:
            check_range(name, bound, 0)
    names = {"PHARMA_NAME": pharma_name, "GENERIC_NAME": generic_name, "DOSAGE_NAME": dosage_name}
    if ignore_case:
        equal = [F.lower(c) == v.lower() for c, v in names.items() if v]
    else:
        equal = equal_to(product, **names)
    price = C.number("UNIT_PRICE")
    found = where_all(
        product,
        equal,
        contains_text("PRODUCT_NAME", product_name, ignore_case),
        within(price, min_price, max_price),
    )
    return (
        found.select(*MASTER_COLUMNS[:-1], price.alias("unit_price"))
        .orderBy("PRODUCT_NAME", "PRODUCT_ID")
        .limit(limit)
    )


def product_missing(product: DataFrame) -> DataFrame:
    return quality.null_profile(product, MASTER_COLUMNS)


def product_uniqueness(product: DataFrame) -> DataFrame:
    return quality.key_profile(product, "PRODUCT_ID")


def product_duplicates(product: DataFrame, list_limit: int = 200) -> DataFrame:
    return quality.duplicate_keys(product, "PRODUCT_ID", list_limit)


def product_price_stats(
    product: DataFrame, sample_limit: int | None = None, approx: bool = False
) -> DataFrame:
    """Count, NULLs, range, mean, deviation and quartiles of the price.

    The products are scanned once, into the number of rows of every price; all measures follow
    from that. ``sample_limit`` restricts the quartiles to the first priced products by id.
    """
    price, raw = C.number("UNIT_PRICE"), F.col("UNIT_PRICE")
    counted = product.groupBy(price.alias("value"), raw.isNull().alias("missing")).agg(F.count("*").alias("cnt"))
    counted = written(counted, "price-frequencies")
    value, cnt = F.col("value"), F.col("cnt")
    priced = F.sum(F.when(value.isNotNull(), cnt))
    # The mean first, then deviations from it: both passes read the few written rows.
    mean = counted.agg((F.sum(value * cnt) / priced).alias("mean"))
    off = value - F.col("mean")
    one = F.lit(1)
    stats = counted.withColumn("_one", one).join(F.broadcast(mean.withColumn("_one", one)), "_one").agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("missing"), cnt)), F.lit(0)).alias("nulls"),
        F.min("value").alias("min_price"),
        F.max("value").alias("max_price"),
        F.max("mean").alias("avg_price"),
        F.sqrt(F.try_divide(F.sum(off * off * cnt), F.nullif(priced - 1, F.lit(0)))).alias("std_price"),
        F.lit(1).alias("_one"),
    )
    prices, freq = product, None
    if sample_limit is not None:
        check_range("sample_limit", sample_limit, 1)
        prices = product.filter(price.isNotNull()).orderBy("PRODUCT_ID").limit(sample_limit)
    elif not approx:
        known = counted.filter(value.isNotNull() & ~F.isnan("value"))
        freq = known.groupBy(F.lit("UNIT_PRICE").alias("column"), "value").agg(F.sum("cnt").alias("cnt"))
    if approx:
        found = approximate_quantiles(prices, ["UNIT_PRICE"], [0.25, 0.5, 0.75])
    else:
        found = exact_quantiles(prices, ["UNIT_PRICE"], [0.25, 0.5, 0.75], freq)
    q = F.col("quantiles")
    # Two one-row frames side by side.
    quartiles = found.select(one.alias("_one"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))
    return stats.join(F.broadcast(quartiles), "_one").drop("_one")


def product_value_counts(product: DataFrame, top_n: int = 50) -> DataFrame:
    return quality.value_counts(product, CATEGORY_COLUMNS, top_n, with_distinct=True)


def product_text_quality(product: DataFrame, sample: int | None = None) -> DataFrame:
    return quality.text_quality(product, TEXT_COLUMNS, sample, "PRODUCT_ID").drop(
        "non_plain", "non_plain_ratio"
    )


def generic_dosage(product: DataFrame, top_n: int = 200) -> DataFrame:
    """How often a generic name and a dosage form occur together."""
    check_range("top_n", top_n, 1, 2000)
    pairs = product.groupBy("GENERIC_NAME", "DOSAGE_NAME").agg(F.count("*").alias("cnt"))
    return pairs.orderBy(F.desc("cnt"), "GENERIC_NAME", "DOSAGE_NAME").limit(top_n)

"""Queries over the market hierarchy table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.functions import columns as C
from salesops.functions.params import check_range, contains_text, equal_to, where_all
from salesops.operators import quality

MARKET_COLUMNS = ["FIELD_ID", "MKT_NAME", "MKT_LEVEL", "PARENT_MKT_CODE", "MKT_CODE_OLD"]


def _with_level(market: DataFrame) -> DataFrame:
    return market.select(*MARKET_COLUMNS).withColumn("MKT_LEVEL", C.whole_number(market, "MKT_LEVEL"))


def market_summary(market: DataFrame) -> DataFrame:
    return _with_level(market).agg(
        F.count("*").alias("node_count"),
        F.count_distinct("MKT_LEVEL").alias("level_count"),
        F.min("MKT_LEVEL").alias("min_level"),
        F.max("MKT_LEVEL").alias("max_level"),
    )


def market_search(
    market: DataFrame,
    level: int | None = None,
    parent_mkt_code: str | None = None,
    search: str | None = None,
    limit: int = 500,
    ignore_case: bool = False,
) -> DataFrame:
    """Nodes that meet every given condition, first ``limit`` by level and name."""
    check_range("limit", limit, 1, 5000)
    if level is not None:
        check_range("level", level, 0)
    nodes = _with_level(market)
    found = where_all(
        nodes,
        equal_to(nodes, MKT_LEVEL=level, PARENT_MKT_CODE=parent_mkt_code),
        contains_text("MKT_NAME", search, ignore_case),
    )
    return found.orderBy("MKT_LEVEL", "MKT_NAME", "FIELD_ID").limit(limit)


def level_distribution(market: DataFrame) -> DataFrame:
    return (
        _with_level(market)
        .groupBy(F.col("MKT_LEVEL").alias("level"))
        .agg(F.count("*").alias("row_count"), F.count_distinct("FIELD_ID").alias("unique_field_ids"))
        .orderBy("level")
    )


def field_uniqueness(market: DataFrame) -> DataFrame:
    """Rows, distinct ids, and rows whose id occurs more than once (counted over all ids)."""
    return quality.key_counts(market, "FIELD_ID").agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_rows"),
        F.count("FIELD_ID").alias("distinct_field_ids"),
        F.coalesce(F.sum(F.when(F.col("cnt") > 1, F.col("cnt"))), F.lit(0)).alias("non_unique_count"),
    )


def duplicate_fields(market: DataFrame, list_limit: int = 200) -> DataFrame:
    return quality.duplicate_keys(market, "FIELD_ID", list_limit)


def market_missing(market: DataFrame) -> DataFrame:
    return quality.null_profile(market, MARKET_COLUMNS)


def name_quality(market: DataFrame, sample: int | None = None) -> DataFrame:
    """Spacing and case defects of the node names, and the share with unusual characters."""
    return quality.text_quality(market, ["MKT_NAME"], sample, "FIELD_ID").select(
        F.col("n").alias("sample"),
        "leading_spaces",
        "trailing_spaces",
        "multi_spaces",
        F.col("case_variant_issue").alias("has_case_variants"),
        F.col("non_plain_ratio").alias("non_alnum_ratio"),
    )


def children_count(market: DataFrame, top_n: int = 500) -> DataFrame:
    """Parents with the most children."""
    check_range("top_n", top_n, 1, 10_000)
    return (
        market.filter(F.col("PARENT_MKT_CODE").isNotNull())
        .groupBy(F.col("PARENT_MKT_CODE").alias("parent_id"))
        .agg(F.count("*").alias("children"))
        .orderBy(F.desc("children"), "parent_id")
        .limit(top_n)
    )

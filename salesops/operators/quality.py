"""Data-quality profiles over any frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.functions.params import check_range

# Fixed patterns; (?U) gives \s its Unicode meaning, the control separators count as space too.
LEADING_SPACE = r"(?U)^[\s\x1c-\x1f]"
TRAILING_SPACE = r"(?U)[\s\x1c-\x1f]\z"
SPACE_RUN = r"(?U)[\s\x1c-\x1f]{2,}"
PLAIN_NAME = r"(?U)^[\p{L}\p{N}_\s\x1c-\x1f\-]+\z"


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: NULL count per column, its share of the rows in percent, and the row count."""
    counts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
        F.count("*").alias("total_rows"),
    )
    rows = F.greatest(F.col("total_rows"), F.lit(1))
    return counts.select("*", *[(F.col(c) / rows * 100.0).alias(f"{c}_pct") for c in columns])


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("cnt"))


def key_profile(df: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys (NULL is one), keys that repeat, rows they cover."""
    repeats = F.col("cnt") > 1
    return key_counts(df, key).agg(
        F.count("*").alias("total_ids"),
        F.count_if(repeats).alias("non_unique_ids"),
        F.coalesce(F.sum(F.when(repeats, F.col("cnt"))), F.lit(0)).alias("total_duplicate_rows"),
    )


def duplicate_keys(df: DataFrame, key: str, limit: int = 200, max_limit: int = 5000) -> DataFrame:
    """The keys with most repeats."""
    check_range("limit", limit, 1, max_limit)
    return key_counts(df, key).filter("cnt > 1").orderBy(F.desc("cnt"), key).limit(limit)


def _column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], columns, "column", "value")


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, cnt): how often every value of each column occurs, from one scan."""
    return _column_values(df, columns).groupBy("column", "value").agg(F.count("*").alias("cnt"))


def most_frequent(counts: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` values of each column; every task keeps that many before the shuffle."""
    check_range("top_n", top_n, 1, 1000)
    best = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc_nulls_first("value"))
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_n).drop("rank")


def value_counts(
    df: DataFrame, columns: list[str], top_n: int = 50, with_distinct: bool = False
) -> DataFrame:
    """(column, value, cnt): the most frequent values of each column, NULL included.

    One scan and one grouping serve all columns. ``with_distinct`` adds the number of non-NULL
    values.
    """
    counts = column_counts(df, columns)
    top = most_frequent(counts, top_n)
    if not with_distinct:
        return top
    distinct = counts.groupBy("column").agg(F.count("value").alias("distinct"))
    # One row per profiled column.
    return top.join(F.broadcast(distinct), "column")


def _compact(text: Column) -> Column:
    """Short text as it is, long text as its SHA-256 digest, so that a shuffle stays narrow."""
    return F.when(F.length(text) < 64, text).otherwise(F.sha2(text, 256))


def text_quality(
    df: DataFrame, columns: list[str], sample_limit: int | None = None, order: str | None = None
) -> DataFrame:
    """Spacing and case defects per text column; NULLs are not values.

    (column, n, leading_spaces, trailing_spaces, multi_spaces, non_plain, non_plain_ratio,
    case_variant_issue). The issue is set when two values differ in case only. The patterns run
    on the scan side; the case check groups distinct values by their lower-case form instead of
    counting distinct texts twice per column.
    """
    if sample_limit is not None:
        df = df.orderBy(order or columns[0]).limit(check_range("sample", sample_limit, 100, 200_000))
    value = F.col("value")
    distinct = (
        _column_values(df, columns)
        .filter(value.isNotNull())
        .groupBy("column", _compact(F.lower(value)).alias("folded"), _compact(value).alias("exact"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(value.rlike(LEADING_SPACE)).alias("leading"),
            F.count_if(value.rlike(TRAILING_SPACE)).alias("trailing"),
            F.count_if(value.rlike(SPACE_RUN)).alias("multi"),
            F.count_if(~value.rlike(PLAIN_NAME)).alias("non_plain"),
        )
    )
    measures = ["n", "leading", "trailing", "multi", "non_plain"]
    folded = distinct.groupBy("column", "folded").agg(
        *[F.sum(m).alias(m) for m in measures], F.count("*").alias("spellings")
    )
    return folded.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.sum("leading").alias("leading_spaces"),
        F.sum("trailing").alias("trailing_spaces"),
        F.sum("multi").alias("multi_spaces"),
        F.sum("non_plain").alias("non_plain"),
        (F.sum("non_plain") / F.sum("n")).alias("non_plain_ratio"),
        (F.max("spellings") > 1).alias("case_variant_issue"),
    )

"""Helpers shared by the corpus operators: tables, written intermediates, words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesops.plans.lineage import scratch_path

# White space is the space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the frame under the shared folder and go on from the files, so that no lineage is rerun."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def blocks_for(rows: int, rows_per_block: int) -> int:
    return max(1, -(-rows // rows_per_block))

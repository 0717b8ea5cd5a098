from __future__ import annotations

import pytest

from salesops.scopes import SALES_HISTORY_SCHEMA
from salesops.sources import tables
from tests.conftest import rows


def test_missing_table(spark):
    assert tables.read_table(spark, "no_such_history", SALES_HISTORY_SCHEMA).isEmpty()
    with pytest.raises(ValueError):
        tables.read_table(spark, "no_such_history")
    spark.range(3).createOrReplaceTempView("known_rows")
    assert tables.read_table(spark, "known_rows").count() == 3


def test_parameters_are_bound(spark):
    text = "x' OR '1'='1"
    found = tables.query(spark, "SELECT :t AS t, :n + 1 AS n", {"t": text, "n": 4})
    assert rows(found) == [(text, 5)]


def test_failing_statement(spark):
    from pyspark.errors import AnalysisException

    assert tables.query(spark, "SELECT * FROM nowhere", empty_schema=SALES_HISTORY_SCHEMA).isEmpty()
    with pytest.raises(AnalysisException):
        tables.query(spark, "SELECT * FROM nowhere")


def test_parquet_with_schema(spark, small):
    df = tables.read_parquet(spark, f"{small}/nation.parquet")
    assert df.count() == 25
    assert tables.read_parquet(spark, f"{small}/nation.parquet", df.select("n_name").schema).columns == ["n_name"]


def test_sqlserver_options():
    options = tables.sqlserver_options(
        "db:1433", "sales", "dbo.survey", "me", "secret", "ROW_DATA_ID", (1, 10**9), partitions=200
    )
    assert options["url"] == "jdbc:sqlserver://db:1433;databaseName=sales"
    assert options["numPartitions"] == "200" and options["upperBound"] == str(10**9)
    integrated = tables.sqlserver_options("db", "sales", "dbo.product")
    assert integrated["url"].endswith(";integratedSecurity=true") and "user" not in integrated
    with pytest.raises(ValueError):
        tables.sqlserver_options("db", "sales", "dbo.survey", partition_column="ROW_DATA_ID")
    with pytest.raises(ValueError):
        tables.sqlserver_options("db", "sales", "x; drop table y")


def test_newest_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "ROW_DATA_ID")
    assert sorted(rows(tables.newest_rows(df, 2))) == [(8,), (9,)]
    assert tables.newest_rows(df, None).count() == 10
    with pytest.raises(ValueError):
        tables.newest_rows(df, 0)

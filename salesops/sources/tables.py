"""Reading tables: Parquet, JDBC, named SQL, and the fallback chain of sales sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesops.functions.params import check_range


def read_table(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A catalog table or view; an empty frame of the given schema when it does not exist."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if schema is None:
        raise ValueError(f"table {name!r} does not exist")
    return spark.createDataFrame([], schema)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def query(
    spark: SparkSession,
    sql: str,
    params: dict | None = None,
    empty_schema: T.StructType | None = None,
) -> DataFrame:
    """SQL with named parameters, bound and never spliced into the text.

    With ``empty_schema`` a statement that does not resolve gives an empty frame.
    """
    try:
        return spark.sql(sql, args=params or {})
    except (AnalysisException, ParseException):
        if empty_schema is None:
            raise
        return spark.createDataFrame([], empty_schema)


def sqlserver_options(
    server: str,
    database: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """JDBC options for a SQL Server table; integrated security when no user is given.

    With a partition column the table is read in ``partitions`` range slices at once; without
    one JDBC reads through a single task, which only suits small tables.
    """
    if "{" in table or ";" in table:
        raise ValueError(f"not a table name: {table!r}")
    url = f"jdbc:sqlserver://{server};databaseName={database}"
    options = {"dbtable": table, "fetchsize": str(fetch_size)}
    if user and password:
        options.update(user=user, password=password)
    else:
        url += ";integratedSecurity=true"
    options["url"] = url
    if partition_column:
        if bounds is None:
            raise ValueError("a partition column needs its lowest and highest value")
        options.update(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(check_range("partitions", partitions, 1)),
        )
    return options


def read_sqlserver(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**sqlserver_options(**options)).load()


def first_non_empty(*candidates: tuple[DataFrame | None, Callable[[], DataFrame]]) -> DataFrame:
    """The first candidate whose input holds a row; the last one when all are empty.

    A candidate is the input to probe and the function that builds its result. Probing the
    input is a one-row scan, where probing a grouped result would first run the whole grouping.
    """
    for rows, build in candidates[:-1]:
        if rows is not None and not rows.isEmpty():
            return build()
    return candidates[-1][1]()


def newest_rows(df: DataFrame, limit: int | None, order: str = "ROW_DATA_ID") -> DataFrame:
    """The ``limit`` newest rows, or all of them when no limit is given."""
    if limit is None:
        return df
    return df.orderBy(F.desc(order)).limit(check_range("sample_limit", limit, 1))

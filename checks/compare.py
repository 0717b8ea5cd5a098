"""Run queries beside their reference SQL and compare the rows.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import oracle_sql
from checks.queries import queries
from salesops.plans.lineage import release

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session(cores: int = 8) -> SparkSession:
    shared = tempfile.mkdtemp(prefix="salesops-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{shared}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, float) else value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, types of values, and rows agree."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(found) != len(expected):
        return [f"{len(found)} rows instead of {len(expected)}"]
    wrong = [(f, e) for f, e in zip(found, expected) if f != e or list(map(type, f)) != list(map(type, e))]
    return [f"{len(wrong)} of {len(expected)} rows differ: {sorted(names)}: {wrong[:2]}"] if wrong else []


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    spark, connection, sql = local_session(), connect(folder), oracle_sql()
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            if name in sql:
                problems = differences(df, connection, sql[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        release(spark)
        failed += bool(problems)
        mark = "ok " if not problems else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in sql else '(rows only)'}", flush=True)
        for problem in problems:
            print("    ", problem[:2000], flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")


if __name__ == "__main__":
    main()

"""The logical sales tables expressed over the driver's star schema.

A deployment reads its own survey, product and market tables; this module derives the same
layouts from ``lineitem orders supplier nation region part`` with fixed, documented rules. The
driver tables hold no NULLs, so a few attribute values stand for missing or dirty ones. Every
line has its supplier, so the layouts without region and area need no join at all. Queries that sum
lines by place take the lines and ``places`` apart, and sum first. Only where lines themselves are
the result do they meet their places, in a counted lookup join: after a plain join on the
territory a grouping by territory would reuse its partitioning, and a hot territory would stay in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesops.operators.joins import lookup_join


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Area and region of a territory; AREA_ID is NULL for suppliers with a negative balance."""
    supplier = table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    return supplier.join(nation, "n_nationkey").select(
        F.col("s_suppkey").alias("TERRITORY_ID"),
        F.when(F.col("s_acctbal") >= 0, F.col("n_nationkey").cast("long")).alias("AREA_ID"),
        F.col("n_regionkey").cast("long").alias("REGION_ID"),
    )


def _lines(
    spark: SparkSession, folder: str, qty: Column, price: Column, year: Column, month: Column, *more: str
) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ROW_DATA_ID"),
        year.alias("YEAR_NO"),
        month.alias("MONTH_NO"),
        F.col("l_partkey").alias("PRODUCT_ID"),
        qty.alias("SALES_QTY"),
        price.alias("UNIT_PRICE"),
        F.col("l_suppkey").alias("TERRITORY_ID"),
        *more,
    )


def _ship_period() -> tuple[Column, Column]:
    return F.year("l_shipdate"), F.month("l_shipdate")


def _dirty_measures() -> tuple[Column, Column]:
    """NULL quantities on line 5, negative returns, NULL prices on line 4."""
    quantity, line = F.col("l_quantity"), F.col("l_linenumber")
    signed = F.when(F.col("l_returnflag") == "R", -quantity).otherwise(quantity)
    return F.when(line != 5, signed), F.when(line != 4, F.col("l_extendedprice"))


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Survey without region and area."""
    return _lines(spark, folder, F.col("l_quantity"), F.col("l_extendedprice"), *_ship_period())


def quality_lines(spark: SparkSession, folder: str) -> DataFrame:
    """As ``clean_lines``, with missing and negative measures."""
    return _lines(spark, folder, *_dirty_measures(), *_ship_period())


def _placed(lines: DataFrame, folder: str) -> DataFrame:
    return lookup_join(lines, places(lines.sparkSession, folder), "TERRITORY_ID")


def survey(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(clean_lines(spark, folder), folder)


def survey_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(quality_lines(spark, folder), folder)


def circle_lines(spark: SparkSession, folder: str) -> DataFrame:
    """As ``quality_lines``, with the key of their order."""
    return _lines(spark, folder, *_dirty_measures(), *_ship_period(), "l_orderkey")


def circles(spark: SparkSession, folder: str) -> DataFrame:
    """The two text ids that come from an order."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_orderpriority").alias("SURVEY_CIRCLE_ID"),
        F.col("o_custkey").cast("string").alias("PRS_ID"),
    )


def with_circle(lines: DataFrame, folder: str) -> DataFrame:
    """A few ``circle_lines`` with their place and the ids of their order."""
    spark = lines.sparkSession
    placed = lines.join(places(spark, folder), "TERRITORY_ID")
    return placed.join(circles(spark, folder), "l_orderkey").drop("l_orderkey")


def text_period_lines(spark: SparkSession, folder: str) -> DataFrame:
    """As ``quality_lines`` with periods as text, some of them unusual or unusable."""
    line = F.col("l_linenumber")
    year, month = (p.cast("string") for p in _ship_period())
    padded = F.when(line == 1, F.concat(F.lit("0"), year)).when(line == 2, F.concat(year, F.lit(".0")))
    broken = F.when(line == 7, F.lit("13")).when(line == 6, F.lit("x"))
    years = F.when(line != 3, F.coalesce(padded, year))
    return _lines(spark, folder, *_dirty_measures(), years, F.coalesce(broken, month))


def product(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return _product_columns(part, F.col("p_name"))


def product_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Names of sizes 1 to 5 carry spacing, case or NULL defects; sizes from 48 up occur twice."""
    part = table(spark, folder, "part")
    name, size = F.col("p_name"), F.col("p_size")
    dirty = (
        F.when(size == 1, F.concat(F.lit(" "), name))
        .when(size == 2, F.concat(name, F.lit(" ")))
        .when(size == 3, F.replace(name, F.lit(" "), F.lit("  ")))
        .when(size == 4, F.upper(name))
        .when(size != 5, name)
    )
    copies = F.when(size >= 48, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return _product_columns(part.withColumn("_copy", F.explode(copies)), dirty)


def _product_columns(part: DataFrame, name: Column) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("PRODUCT_ID"),
        F.concat(F.lit("P"), F.col("p_partkey")).alias("PRODUCT_CODE"),
        name.alias("PRODUCT_NAME"),
        F.col("p_type").alias("DOSAGE_NAME"),
        F.col("p_brand").alias("PHARMA_NAME"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("GENERIC_NAME"),
        F.col("p_retailprice").alias("UNIT_PRICE"),
    )


def market(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations and suppliers as a three-level forest.

    FIELD_ID is ``F`` + code for suppliers and the code itself above them. Suppliers with a
    negative balance name a parent that does not exist and share one FIELD_ID.
    """

    def code(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix), F.col(key))

    def level(name: str, depth: int, title: str, own: Column, parent: Column, field: Column) -> DataFrame:
        return table(spark, folder, name).select(
            field.alias("FIELD_ID"),
            F.col(title).alias("MKT_NAME"),
            F.lit(depth).alias("MKT_LEVEL"),
            parent.alias("PARENT_MKT_CODE"),
            own.alias("MKT_CODE_OLD"),
        )

    region, nation, supplier = code("R", "r_regionkey"), code("N", "n_nationkey"), code("S", "s_suppkey")
    no_parent = F.lit(None).cast("string")
    lost = F.col("s_acctbal") < 0
    parent = F.when(lost, "ZZ").otherwise(code("N", "s_nationkey"))
    field = F.when(lost, "F?").otherwise(F.concat(F.lit("F"), supplier))
    return (
        level("region", 1, "r_name", region, no_parent, region)
        .unionByName(level("nation", 2, "n_name", nation, code("R", "n_regionkey"), nation))
        .unionByName(level("supplier", 3, "s_name", supplier, parent, field))
    )


def sales_history(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue per territory and month.

    Summed before the join: the lines of a hot territory shrink to one row per month in every
    task, and the join meets months instead of lines.
    """
    amounts = (
        clean_lines(spark, folder)
        .groupBy("TERRITORY_ID", "YEAR_NO", "MONTH_NO")
        .agg(F.sum(F.col("SALES_QTY") * F.col("UNIT_PRICE")).alias("SalesAmount"))
    )
    return amounts.join(places(spark, folder), "TERRITORY_ID").select(
        F.col("REGION_ID").alias("Region"),
        F.col("AREA_ID").alias("Area"),
        F.col("TERRITORY_ID").alias("Territory"),
        "YEAR_NO",
        "MONTH_NO",
        "SalesAmount",
    )

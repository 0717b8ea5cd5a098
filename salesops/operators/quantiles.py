"""Exact quantiles of many columns without gathering a column in one task."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.plans.lineage import written

# Histogram cells of a range of values; a window over them finds the cell of a rank.
CELLS = 65_536
# Distinct values that one task may put in order; a cell with more is divided again.
ORDERED_VALUES = 100_000


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, cnt) of the non-NULL numbers, from one scan.

    Repeats are counted on the map side, so a value that fills a third of the rows is one row
    per task before the shuffle.
    """
    numbers = df.select(*[F.col(c).try_cast("double").alias(c) for c in columns])
    return (
        numbers.unpivot([], columns, "column", "value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value")
        .agg(F.count("*").alias("cnt"))
    )


def _magnitude(value: Column) -> Column:
    """Grows with the value; logarithmic, so that outliers do not swallow the cells.

    Capped just above the largest finite number, which keeps infinities in order.
    """
    return F.signum(value) * F.least(F.log1p(F.abs(value)), F.lit(710.0))


def _ranks(n: int, probabilities: list[float]) -> list[tuple[int, int, float]]:
    """(rank below, rank above, share of the way between them) per probability."""
    positions = [p * (n - 1) for p in probabilities]
    return [(int(at), min(int(at) + 1, n - 1), at - int(at)) for at in positions]


class _Range(NamedTuple):
    """Values from ``low`` to ``high`` of a column, with the wanted ranks among them.

    ``before`` values of the column are smaller. ``logarithmic`` says how cells divide it.
    """

    column: str
    low: float
    high: float
    before: int
    ranks: tuple[int, ...]
    logarithmic: bool

    def holds(self) -> Column:
        return (F.col("column") == self.column) & F.col("value").between(self.low, self.high)

    def cell(self) -> Column:
        value = F.col("value")
        if self.low == self.high:
            return F.lit(0)
        if self.logarithmic:
            edges = F.struct(_magnitude(F.lit(self.low)).alias("low"), _magnitude(F.lit(self.high)).alias("high"))
            place = (_magnitude(value) - edges["low"]) / (edges["high"] - edges["low"])
        else:
            # Halves keep the width of the widest range finite.
            place = (value / 2 - self.low / 2) / F.lit(self.high / 2 - self.low / 2)
        return F.floor(place * (CELLS - 1)).cast("int")


def _divided(freq: DataFrame, ranges: list[_Range]) -> tuple[list[_Range], list[_Range]]:
    """The cells of the ranges that hold wanted ranks: those to divide again, and small ones.

    One aggregation of the written values for all ranges. The driver sees one row per rank.
    """
    number, cell = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, r in enumerate(ranges):
        number = F.when(r.holds(), i).otherwise(number)
        cell = F.when(r.holds(), r.cell()).otherwise(cell)
    up_to = Window.partitionBy("range").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        freq.withColumns({"range": number, "cell": cell})
        .filter(F.col("range").isNotNull())
        .groupBy("range", "cell")
        .agg(
            F.sum("cnt").alias("cnt"), F.count("*").alias("distinct"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        .withColumn("before", F.sum("cnt").over(up_to) - F.col("cnt"))
    )
    asked = F.array().cast("array<bigint>")
    for i, r in enumerate(ranges):
        own = F.array(*[F.lit(rank - r.before).cast("bigint") for rank in r.ranks])
        asked = F.when(F.col("range") == i, own).otherwise(asked)
    covered = F.filter(asked, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("cnt")))
    large, small = [], []
    for hit in cells.withColumn("hit", covered).filter(F.size("hit") > 0).orderBy("range", "cell").collect():
        parent = ranges[hit["range"]]
        ranks = tuple(parent.before + k for k in hit["hit"])
        found = _Range(parent.column, hit["low"], hit["high"], parent.before + hit["before"], ranks, False)
        few = hit["distinct"] <= ORDERED_VALUES or (found.low, found.high) == (parent.low, parent.high)
        (small if few else large).append(found)
    return large, small


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], freq: DataFrame | None = None
) -> DataFrame:
    """(column, n, min, max, quantiles) with linear interpolation between neighbours.

    ``percentile`` ends in one task that holds every distinct value of a column. Here the
    distinct values are written once (or given as ``freq``) and stay spread over the cluster: a
    histogram of at most CELLS cells per column finds the cell of each wanted rank, a cell with
    more than ORDERED_VALUES values is divided again in the same way, and only the values of
    small cells are put in order. The ranks are exact whatever the cells look like. The driver
    sees one row per column and one per wanted rank. ``n`` is 0 for a column without values.
    """
    spark = df.sparkSession
    freq = written(value_frequencies(df, columns), "value-frequencies") if freq is None else freq
    spans = (
        freq.groupBy("column")
        .agg(F.sum("cnt").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))
        .collect()
    )
    ranks = {s["column"]: _ranks(s["n"], probabilities) for s in spans}
    pending, ready = [], []
    for s in spans:
        wanted = tuple(sorted({r for low, high, _ in ranks[s["column"]] for r in (low, high)}))
        pending.append(_Range(s["column"], s["min"], s["max"], 0, wanted, True))
    while pending:
        pending, small = _divided(freq, pending)
        ready += small
    values = _ordered(freq, ready).groupBy("column").agg(
        F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("at")
    )
    known = [(s["column"], s["n"], s["min"], s["max"], ranks[s["column"]]) for s in spans]
    empty = [(c, 0, None, None, []) for c in columns if c not in ranks]
    schema = (
        "column string, n bigint, min double, max double, "
        "ranks array<struct<low: bigint, high: bigint, share: double>>"
    )

    def between(rank: Column) -> Column:
        low, high = F.element_at("at", rank["low"]), F.element_at("at", rank["high"])
        return F.when(low == high, low).otherwise(low + (high - low) * rank["share"])

    return (
        spark.createDataFrame(known + empty, schema)
        .join(F.broadcast(values), "column", "left")
        .select(
            "column",
            "n",
            "min",
            "max",
            F.when(F.col("n") > 0, F.transform("ranks", between)).alias("quantiles"),
        )
    )


def _ordered(freq: DataFrame, ranges: list[_Range]) -> DataFrame:
    """(column, rank, value) of the wanted ranks, from the values of their small ranges."""
    number, before = F.lit(None).cast("int"), F.lit(0).cast("bigint")
    asked = F.array().cast("array<bigint>")
    for i, r in enumerate(ranges):
        number = F.when(r.holds(), i).otherwise(number)
        before = F.when(F.col("range") == i, F.lit(r.before).cast("bigint")).otherwise(before)
        own = F.array(*[F.lit(rank).cast("bigint") for rank in r.ranks])
        asked = F.when(F.col("range") == i, own).otherwise(asked)
    in_range = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        freq.withColumn("range", number)
        .filter(F.col("range").isNotNull())
        .withColumn("start", before + F.sum("cnt").over(in_range) - F.col("cnt"))
    )
    start, end = F.col("start"), F.col("start") + F.col("cnt")
    covered = F.filter(asked, lambda rank: (rank >= start) & (rank < end))
    return placed.withColumn("rank", F.explode(covered)).select("column", "rank", "value")


def approximate_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = 10_000
) -> DataFrame:
    """As ``exact_quantiles`` from a bounded sketch: one scan, rank error at most 1/accuracy."""
    numbers = df.select(*[F.col(c).try_cast("double").alias(c) for c in columns])
    return (
        numbers.unpivot([], columns, "column", "value")
        .groupBy("column")
        .agg(
            F.count("value").alias("n"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.percentile_approx("value", [float(p) for p in probabilities], accuracy).alias("quantiles"),
        )
    )

"""Joins against a lookup side that is small in practice but not by contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesops.plans.lineage import cut

# A lookup row holds a few short columns: 100,000 of them stay in the tens of megabytes.
BROADCAST_ROWS = 100_000
# A key is hot above 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 5_000
SALT_BUCKETS = 64


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "inner",
    max_broadcast_rows: int = BROADCAST_ROWS,
    salt: int = SALT_BUCKETS,
) -> DataFrame:
    """Join ``big`` with ``lookup`` on one column of the same name.

    The lookup is counted first. Up to ``max_broadcast_rows`` it is broadcast, so hot keys of
    ``big`` never meet in one task. Beyond that both sides are shuffled, with the hot keys of
    ``big`` spread over ``salt`` tasks: their rows get a salt, and only their lookup rows are
    repeated once per salt. Every row still meets exactly its matches. ``big`` is then read twice,
    to count its keys and to join. Where only sums of ``big`` are wanted, use ``summed_by_place``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if lookup.count() <= max_broadcast_rows:
        return big.join(F.broadcast(lookup), on, how)
    hot = hot_keys(big, on)
    # The salt follows the row and the task that reads it. Copies of one row spread as well, and
    # a task that is run again gives every row the salt it had.
    spread = F.pmod(F.xxhash64(*big.columns, F.spark_partition_id()), F.lit(salt)).cast("int")
    # A NULL key matches nothing wherever it goes.
    salted = big.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(on).isNull(), spread).otherwise(0)
    )
    every = F.sequence(F.lit(0), F.lit(salt - 1))
    copies = lookup.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    )
    return salted.drop("_hot").join(copies.drop("_hot"), [on, "_salt"], how).drop("_salt")


def hot_keys(big: DataFrame, on: str, share: int = HOT_SHARE) -> DataFrame:
    """(key, _hot): the keys that hold more than 1/``share`` of the rows.

    One pass over the rows, counted on the map side; their total is the sum of the written counts.
    """
    counts = cut(big.groupBy(on).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col(on).isNotNull() & (F.col("n") * share > total))
    return hot.select(on, F.lit(True).alias("_hot"))


def summed_by_place(
    lines: DataFrame,
    places: DataFrame | None,
    keys: dict[str, Column],
    sums: dict[str, Column],
    on: str = "TERRITORY_ID",
) -> DataFrame:
    """Sums of lines by keys (name to expression) that may belong to the place of a line.

    Without ``places`` the lines hold every column themselves. With it they hold only ``on``: they
    are summed by it and by the keys they do have, on the map side first, and the sums, not the
    lines, meet the places. A hot place is then one row per key in every task. The lines are
    read once, whatever the size of ``places``.
    """
    totals = [F.sum(c).alias(n) for n, c in sums.items()]
    if places is None:
        return lines.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*totals)
    own = {n: c for n, c in keys.items() if n not in places.columns}
    first = lines.groupBy(on, *[c.alias(n) for n, c in own.items() if n != on]).agg(*totals)
    return first.join(places, on).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])

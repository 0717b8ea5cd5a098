"""A sales history that batches of facts maintain.

A batch holds facts that come in and facts that go, of any month: late ones and corrected ones, which are the old
fact taken out and the new one put in. It is summed to one signed row per key and month, written, and counts from the
moment its row stands in the ``commits`` table. A batch that is sent again counts once, one that breaks off
not at all. The history is the sum of what is committed; ``compact`` writes that sum as one base, which takes the
place of the batches before it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesops.functions import columns as C
from salesops.operators.joins import summed_by_place
from salesops.scopes import SURVEY_KEYS

KEYS = [*SURVEY_KEYS.values(), "YEAR_NO", "MONTH_NO"]
_COMMIT = "number long, batch string, name string, base boolean"


def changes(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Facts with their ``sign``: 1 for those that come in, -1 for those that go."""
    rows = added.withColumn("sign", F.lit(1))
    return rows if removed is None else rows.unionByName(removed.withColumn("sign", F.lit(-1)))


class SalesHistory:
    """The history under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> list:
        """Committed rows from the newest base on; one small row per batch."""
        try:
            rows = self.spark.read.schema(_COMMIT).parquet(f"{self.folder}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return rows.orderBy("number", "name").collect()

    def committed(self, batch: str) -> bool:
        return any(r["batch"] == batch for r in self._commits())

    def commit(self, batch: str, facts: DataFrame, places: DataFrame | None = None) -> bool:
        """Add a batch of signed survey facts (``changes``); False if it was there already.

        Facts without a period belong to no month. With ``places`` the facts hold only their territory, and
        their sums meet the places.
        """
        if self.committed(batch):
            return False
        usable = facts.filter(F.col("YEAR_NO").isNotNull() & F.col("MONTH_NO").isNotNull())
        keys = {
            **{source: F.col(source) for source in SURVEY_KEYS},
            "YEAR_NO": C.whole_number(facts, "YEAR_NO"),
            "MONTH_NO": C.whole_number(facts, "MONTH_NO"),
        }
        sums = {"SalesAmount": C.revenue_or_zero() * F.col("sign"), "facts": F.col("sign").cast("long")}
        rows = summed_by_place(usable, places, keys, sums)
        named = rows.select(*[F.col(s).alias(k) for s, k in SURVEY_KEYS.items()], "YEAR_NO", "MONTH_NO", "SalesAmount", "facts")
        self._write(batch, named, base=False)
        return True

    def _write(self, batch: str, rows: DataFrame, base: bool) -> None:
        name = f"{batch}-{uuid.uuid4().hex}" if batch.isalnum() else uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/sums/{name}")
        number = max((r["number"] for r in self._commits()), default=0) + 1
        row = self.spark.createDataFrame([(number, batch, name, base)], _COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _live(self) -> list[str]:
        """Folders that make up the history: each batch once, the newest base instead of all before it."""
        live: dict[str, str] = {}
        for row in self._commits():
            if row["base"]:
                live = {"": row["name"]}
            elif row["batch"] not in live:
                live[row["batch"]] = row["name"]
        return [f"{self.folder}/sums/{name}" for name in live.values()]

    def sums(self) -> DataFrame | None:
        """(keys, YEAR_NO, MONTH_NO, SalesAmount, facts) of the months that hold facts; None without a batch."""
        live = self._live()
        if not live:
            return None
        rows = self.spark.read.parquet(*live).groupBy(*KEYS)
        return rows.agg(F.sum("SalesAmount").alias("SalesAmount"), F.sum("facts").alias("facts")).filter("facts != 0")

    def read(self) -> DataFrame | None:
        """The history in the layout that ``series.sales_amounts`` takes."""
        rows = self.sums()
        return None if rows is None else rows.drop("facts")

    def compact(self) -> None:
        """One base instead of the batches so far, so that a reader sums fewer files.

        Batches committed meanwhile by others would be lost behind the base: compact from the job that commits.
        """
        rows = self.sums()
        if rows is not None:
            self._write("", rows, base=True)

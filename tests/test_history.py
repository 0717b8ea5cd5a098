from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from salesops.operators import series
from salesops.plans.lineage import scratch_path
from salesops.sources.history import SalesHistory, changes
from tests.conftest import rows

COLUMNS = "REGION_ID int, AREA_ID int, TERRITORY_ID int, YEAR_NO int, MONTH_NO int, SALES_QTY double, UNIT_PRICE double"
FACTS = [
    (1, 1, 1, 2020, 1, 2.0, 10.0), (1, 1, 1, 2020, 1, 1.0, 5.0), (1, 1, 2, 2020, 2, 3.0, 1.0),
    (1, None, 3, 2020, 2, 4.0, 1.0), (1, 1, 1, None, 2, 9.0, 9.0), (2, 1, 4, 2021, 3, None, 7.0),
]


@pytest.fixture()
def kept(spark):
    return SalesHistory(spark, scratch_path(spark, "history"))


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(FACTS, COLUMNS)


def amounts(history: SalesHistory) -> dict:
    return {tuple(r)[:5]: r["SalesAmount"] for r in history.read().collect()}


def test_nothing_yet(kept):
    assert kept.read() is None and not kept.committed("a")
    kept.compact()
    assert kept.read() is None


def test_batches_add_up_and_count_once(kept, facts):
    assert kept.commit("a", changes(facts.filter("YEAR_NO = 2020")))
    assert kept.commit("b/1", changes(facts.filter("YEAR_NO = 2021 OR YEAR_NO IS NULL")))
    assert not kept.commit("a", changes(facts.filter("YEAR_NO = 2020")))
    whole = {(1, 1, 1, 2020, 1): 25.0, (1, 1, 2, 2020, 2): 3.0, (1, None, 3, 2020, 2): 4.0, (2, 1, 4, 2021, 3): 0.0}
    assert amounts(kept) == whole
    kept.compact()
    assert amounts(kept) == whole and len(kept._live()) == 1
    # A batch sent again after its sums went into a base still counts once.
    assert not kept.commit("b/1", changes(facts))
    old, new = facts.filter("TERRITORY_ID = 2"), facts.filter("TERRITORY_ID = 2").withColumn("SALES_QTY", F.lit(5.0))
    kept.commit("c", changes(new, old))
    kept.commit("d", changes(facts.limit(0), facts.filter("TERRITORY_ID = 3")))
    del whole[1, None, 3, 2020, 2]
    assert amounts(kept) == {**whole, (1, 1, 2, 2020, 2): 5.0}


def test_a_batch_that_breaks_off_does_not_count(kept, facts):
    kept.commit("a", changes(facts.filter("TERRITORY_ID = 1")))
    before = amounts(kept)
    broken = facts.withColumn("UNIT_PRICE", F.when(F.col("TERRITORY_ID") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("UNIT_PRICE")))
    with pytest.raises(Exception, match="lost"):
        kept.commit("b", changes(broken))
    assert amounts(kept) == before and not kept.committed("b")
    assert kept.commit("b", changes(facts.filter("TERRITORY_ID = 2")))
    assert len(amounts(kept)) == 2


def test_the_chain_takes_the_history_first(kept, facts):
    kept.commit("a", changes(facts))
    by_history = series.sales_amounts(kept.read(), facts.limit(0), "territory")
    by_survey = series.sales_amounts(None, facts, "territory")
    order = ["Region", "Area", "Territory", "Year", "Month"]
    assert rows(by_history.orderBy(*order)) == rows(by_survey.orderBy(*order))

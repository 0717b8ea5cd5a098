"""Every registered query against its reference SQL at the smallest scale.

The tree queries fit hundreds of rounds, a minute or two each: one of them stands for all here,
``python -m checks.compare`` runs them all.
"""

from __future__ import annotations

import pytest

from checks.compare import connect, differences
from checks.oracle import oracle_sql
from checks.queries import queries
from tests.conftest import SMALL


SLOW = {
    "trees_a_forecast",
    "trees_b_forecast",
    "trees_a_forecast_area",
    "evaluate_trees_a",
    "evaluate_trees_b",
    "compare_stored_models",
}


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_every_query_has_a_statement():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SLOW))
def test_query_matches_sql(spark, connection, name):
    assert differences(queries()[name](spark, SMALL), connection, oracle_sql()[name]) == []


def test_entry_point(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.compare import local_session  # noqa: E402
from salesops.plans.lineage import release  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marquee.session import local_session

    session = local_session("tests", 8, **{"spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Strings as the one-column DataFrame a text file gives."""
    return lambda *values: spark.createDataFrame([(value,) for value in values], "value string")


@pytest.fixture
def ratings_of(spark):
    return lambda *rows: spark.createDataFrame(
        list(rows), "uid int, mid int, score double, timestamp int"
    )


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

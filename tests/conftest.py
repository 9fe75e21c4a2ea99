from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from razao.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, **{"spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate an expression over texts and return the results in order."""

    def run(texts, expression, kind="string"):
        df = spark.createDataFrame(list(enumerate(texts)), f"i int, v {kind}")
        from pyspark.sql import functions as F

        rows = df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
        return [row.r for row in rows]

    return run

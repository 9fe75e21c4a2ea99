"""Every registered query against its oracle SQL on the smallest tables."""

from __future__ import annotations

import pytest

from razao import catalog
from tools.check import connect, rows_of

SF = "/root/testdata/sf0.001"
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLE:
        return
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, result.fetchall())


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(ORACLE)

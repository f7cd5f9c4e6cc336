"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from veilframe.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(x):
    return "-" if x is None else repr(round(float(x), 8)) if isinstance(x, (int, float)) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    assert rows
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert columns == sorted(duck.sql(sql).columns)
        assert rows == sorted(tuple(map(plain, r)) for r in duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall())

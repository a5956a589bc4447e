"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from docfields import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in queries.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    one = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted([tuple(one(v) for v in r) for r in rows], key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, duck, name):
    frame = __spark_entry__.queries()[name](spark, SF)
    names = sorted(frame.columns)
    got = plain(frame.select(*names).collect(), names)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got
    else:
        assert got == plain(duck.sql(f"select {', '.join(names)} from ({sql}) as q").fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1500

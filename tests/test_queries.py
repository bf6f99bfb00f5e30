"""Every query runs on the smallest tables, and those with SQL give what DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from readloom.queries import core

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 9) if isinstance(v, float) else str(v)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, tables, name):
    df = core.QUERIES[name](spark, DATA)
    got = plain(df.collect(), df.columns)
    if name not in core.SQL:
        assert got
        return
    result = tables.execute(core.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain(result.fetchall(), names)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())

"""The queries of the training-data operators on the smallest tables, against DuckDB where SQL can tell."""

import os

import pytest

from readloom.llm import queries
from tests.test_queries import DATA, plain, tables  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):  # noqa: F811
    df = queries.QUERIES[name](spark, DATA)
    got = plain(df.collect(), df.columns)
    if name in queries.SQL:
        result = tables.execute(queries.SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == plain(result.fetchall(), names)

"""Every query that has SQL gives the SQL's rows on the smallest tables; every query runs."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differ

FOLDER = "/root/testdata/sf0.001"
CORE = {n: f for n, f in entry.queries().items() if not f.__module__.startswith("tallyloom.llm")}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(CORE))
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    df = CORE[name](spark, FOLDER)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert differ(df, con, sql) == ""


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 100

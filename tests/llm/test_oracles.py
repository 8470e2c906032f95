"""Queries of the subpackage against their SQL on the smallest tables."""

import pytest

from tallyloom.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differ

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert differ(df, connect(FOLDER), ORACLES[name]) == ""
    else:
        assert df.columns and df.count() > 0

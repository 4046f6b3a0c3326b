"""Every registered query against its DuckDB statement on the smallest tables."""

import os

import pytest

from doctables.workload import load_all
from tests.oracle import compare, connect

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query(spark, con, name):
    entry = load_all()[name]
    df = entry.run(spark, FOLDER)
    if entry.sql is None:
        assert df.count() > 0
    else:
        result = compare(df, con, entry.sql)
        assert result is None, result

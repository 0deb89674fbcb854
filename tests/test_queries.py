"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    bad, rows = differences(spark, con, name, QUERIES[name], SQL.get(name), SF_DIR)
    assert not bad
    assert rows


def test_contract(spark):
    assert SQL.keys() <= QUERIES.keys()
    assert not entry.entry(spark).isEmpty()

"""Registered queries against their check SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry_module
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "ea_predicted_positive_ratio" in df.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_check(spark, connection, name):
    assert compare(QUERIES[name](spark, FOLDER), connection.sql(SQL[name])) == ""

"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as contract
from tests.check_oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLE.get(name))
    assert ok, note


def test_entry(spark):
    assert contract.entry(spark).count() > 0

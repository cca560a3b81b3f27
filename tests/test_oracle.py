"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest

import __spark_entry__ as contract
from compare import difference, oracle_connection

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, TWINS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


def test_every_twin_belongs_to_a_query():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    if name in TWINS:
        assert difference(df, connection, TWINS[name]) is None
    else:
        assert not df.isEmpty()


def test_entry(spark):
    assert contract.entry(spark).count() > 0

"""Every registered query against its SQL check on the small tables."""

import pytest
from checking import check_connection, compare_query

import __spark_entry__ as entry
from packetcheck.catalog import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_connection(SF)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare_query(spark, con, QUERIES[name], CHECKS[name], SF) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

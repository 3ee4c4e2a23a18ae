"""Every query against its SQL counterpart, and a row check for the others."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert not QUERIES[name](spark, SF_DIR).isEmpty()


def test_entry_runs(spark):
    assert "accuracy_1" in entry.entry(spark).columns

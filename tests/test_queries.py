"""Every core query against its SQL, and the contract of the entry points."""

import pytest
from comparing import DATA, assert_same, connection

import __spark_entry__ as entry
from terazi.plans import catalog


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, DATA), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, con, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_masking_can_be_undone(spark, con):
    assert catalog.QUERIES["masked_decisions"](spark, DATA).filter("not geri").count() == 0


def test_entry(spark, con):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""The registered queries of the subpackage over the smallest tables."""

import pytest
from comparing import DATA, assert_same, connection

from terazi.llm import queries

COLUMNS = {
    "p1_found": {"kaynak": "string", "kayit_no": "bigint"},
    "p2_found": {"id_a": "string", "id_b": "string"},
    "p3_found": {"kaynak": "string", "belge_id": "string", "tur": "string", "bas": "int"},
    "p4_found": {"kaynak": "string", "alan": "string", "kayit_no": "bigint"},
    "p5_found": {"kayit_no": "bigint", "sinir": "string"},
    "p6_found": {"kaynak": "string", "kayit_no": "bigint"},
    "p7_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p8_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p9_found": {"doc_id": "bigint", "bas": "int", "uzunluk": "int"},
    "p9_kept": {"doc_id": "bigint", "text": "string", "cikan": "int"},
}


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, DATA), con, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_gives_rows_of_its_columns(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() > 0
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL)))
def test_columns_of_queries_with_sql(spark, con, name):
    assert dict(queries.QUERIES[name](spark, DATA).dtypes) == COLUMNS[name]

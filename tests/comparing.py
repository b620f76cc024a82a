"""Rows of a query against rows of its SQL."""

import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def connection():
    if not os.path.isdir(DATA):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = os.path.join(DATA, name)
        files = path + "/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    return con


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(_plain(row[names.index(c)]) for c in columns)) for row in found.fetchall())
    assert sorted(repr(tuple(_plain(row[c]) for c in columns)) for row in df.collect()) == expected

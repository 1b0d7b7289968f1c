"""Every query with SQL gives the rows that DuckDB gives for it, at the smallest scale."""

import math
import os

import duckdb
import pytest

from quarrylib.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for name in os.listdir(D):
        out.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{D}/{name}'")
    return out


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 9) if isinstance(value, float) else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, D)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())

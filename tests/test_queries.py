"""Every query with an SQL twin gives the same rows; the others run and have rows."""

import math

import duckdb
import pytest

from flowloom.workload import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def as_sorted(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    want_cols = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(want_cols)
    assert as_sorted(df.collect(), df.columns) == as_sorted(want.fetchall(), want_cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

"""Partial rebuild of a feature table: what is written again, what stays, what a failure leaves."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowloom.sources import rebuild as B


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    pq.write_table(pa.table({"k": [k for k, _ in rows], "v": [float(v) for _, v in rows]}), f"{folder}/{name}.parquet")


def double(df):
    return df.select("k", (F.col("v") * 2).alias("v"), B.PART)


def rows(spark, root, version=None):
    return sorted((r.k, r.v, r.built_at) for r in B.read_features(spark, root, version).collect())


def parts(root, version):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/data/at={version}") for f in fs if f.endswith(".parquet")}


@pytest.fixture
def place(tmp_path):
    source, root = str(tmp_path / "a folder" / "source"), str(tmp_path / "table")
    put(source, "one", [(1, 1), (2, 2)])
    put(source, "two", [(3, 3)])
    put(source, "three", [(4, 4)])
    return source, root


def test_one_changed_file_rewrites_one_part(spark, place):
    source, root = place
    assert B.rebuild(spark, source, root, double) == B.Rebuilt(1, 3, 4)
    assert rows(spark, root) == [(1, 2.0, 1), (2, 4.0, 1), (3, 6.0, 1), (4, 8.0, 1)]
    before = parts(root, 1)
    assert B.rebuild(spark, source, root, double) == B.Rebuilt(1, 0, 0)
    put(source, "two", [(3, 30), (5, 5)])
    assert B.rebuild(spark, source, root, double) == B.Rebuilt(2, 1, 2)
    assert parts(root, 1) == before
    assert rows(spark, root) == [(1, 2.0, 1), (2, 4.0, 1), (3, 60.0, 2), (4, 8.0, 1), (5, 10.0, 2)]
    assert rows(spark, root, 1) == [(1, 2.0, 1), (2, 4.0, 1), (3, 6.0, 1), (4, 8.0, 1)]


def test_new_and_lost_files(spark, place):
    source, root = place
    B.rebuild(spark, source, root, double)
    os.remove(f"{source}/one.parquet")
    put(source, "four", [(6, 6)])
    assert B.rebuild(spark, source, root, double) == B.Rebuilt(2, 1, 1)
    assert rows(spark, root) == [(3, 6.0, 1), (4, 8.0, 1), (6, 12.0, 2)]
    os.remove(f"{source}/four.parquet")
    assert B.rebuild(spark, source, root, double) == B.Rebuilt(3, 0, 0)
    assert rows(spark, root) == [(3, 6.0, 1), (4, 8.0, 1)]


def test_other_settings_rebuild_all(spark, place):
    source, root = place
    B.rebuild(spark, source, root, double, settings="a")
    assert B.rebuild(spark, source, root, double, settings="b") == B.Rebuilt(2, 3, 4)
    assert {r[2] for r in rows(spark, root)} == {2}


def test_a_failed_write_leaves_the_old_table(spark, place):
    source, root = place
    B.rebuild(spark, source, root, double)
    put(source, "two", [(3, 30), (5, 5)])
    broken = lambda df: df.select("k", F.when(F.col("k") == 5, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")).alias("v"), B.PART)
    with pytest.raises(Exception, match="lost"):
        B.rebuild(spark, source, root, broken)
    assert B.current_version(spark, root) == 1 and len(rows(spark, root)) == 4
    assert B.rebuild(spark, source, root, double) == B.Rebuilt(2, 1, 2)
    assert len(rows(spark, root)) == 5


def test_a_file_whose_rows_all_go(spark, place):
    source, root = place
    B.rebuild(spark, source, root, lambda df: double(df.filter("k <> 3")))
    assert sorted(r.n_rows for r in B.manifest(spark, root).collect()) == [0, 1, 2]
    assert len(rows(spark, root)) == 3
    with pytest.raises(ValueError, match="pass the column"):
        B.rebuild(spark, source, root, lambda df: df.select("k"), settings="x")

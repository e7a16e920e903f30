"""Epochs in place: a bijection for any size, the same for any split, no row moved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import epochs as E
from flowloom.operators import sampling as S


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 128, 1000, 4097])
def test_places_are_a_permutation(spark, n):
    keys = E.round_keys(42, 3)
    x = np.arange(n)
    for _ in range(E.most_passes(n, keys)):
        x = np.where((x < n) & (_ > 0), x, E.permuted(x, n, keys))
    assert sorted(x.tolist()) == list(range(n))
    got = [r.p for r in spark.range(n).select(E.epoch_place(F.col("id"), n, 42, 3).alias("p")).collect()]
    assert got == x.tolist()


def test_epochs_differ_and_spread():
    n = 10_000
    a, b = (E.permuted(np.arange(n), n, E.round_keys(1, e)) for e in (0, 1))
    assert (a == b).mean() < 0.01
    # Neighbours end up apart: the mean distance of a random order is a third of the rows.
    assert abs(np.abs(np.diff(a)).mean() / n - 1 / 3) < 0.02 and abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.05


def test_very_large_tables_have_a_place_for_each_row(spark, monkeypatch):
    n = 10**17 + 37  # beyond the whole numbers of a double
    keys = E.round_keys(5, 0)
    x = np.random.default_rng(0).integers(0, n, 1000)
    a, b = E.sides(n)
    y = E.permuted(x, n, keys)
    assert a * b >= n and a * b - n < a and ((y >= 0) & (y < a * b)).all() and len(set(y.tolist())) == len(set(x.tolist()))
    monkeypatch.setattr(E, "most_passes", lambda n, keys: 1)
    df = spark.createDataFrame([(int(v),) for v in x], "x long")
    assert [r.p for r in df.select(E.epoch_place(F.col("x"), n, 5, 0).alias("p")).collect()] == y.tolist()


def test_batches_are_full_resume_and_no_row_moves(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).withColumn("v", F.col("id") * 2).repartition(5).write.parquet(path)
    rows, n = E.dense_numbers(spark, path)
    assert n == 1000 and sorted(r.number for r in rows.collect()) == list(range(1000))
    batches = E.batches_in_place(rows, n, 128, epoch=2)
    sizes = {r.batch_id: r["count"] for r in batches.groupBy("batch_id").count().collect()}
    assert sizes == {**{i: 128 for i in range(7)}, 7: 104}
    assert E.batches_in_place(rows, n, 128, epoch=2, drop_last=True).count() == 896
    plan = batches._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    whole = {(r.id, r.batch_id, r.position) for r in batches.collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        again, _ = E.dense_numbers(spark, path)
        rest = S.resume_batches(E.batches_in_place(again, n, 128, epoch=2), 3).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.id, r.batch_id, r.position) for r in rest} == {w for w in whole if w[1] >= 3}

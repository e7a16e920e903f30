"""Keyed state without a time limit, and thresholds learned inside a stream."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import anomaly as J
from flowloom.streaming import detect as D
from flowloom.streaming import learn
from flowloom.streaming.ledger import run_ledger


def put(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream_of(spark, folder, schema, files=None):
    read = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (read.option("maxFilesPerTrigger", files) if files else read).parquet(folder)


EPOCHS = "epoch int, ts timestamp_ntz, id long"


def test_a_repeat_is_found_however_late(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    put(spark, src, [(1, day(1), 5), (1, day(1), 3), (2, day(2), 4)], EPOCHS, "a")
    first = run_ledger(stream_of(spark, src, EPOCHS), "epoch", "id", base)
    assert sorted((r.epoch, r.id, r.accepted) for r in first.collect()) == [(1, 3, True), (1, 5, False), (2, 4, True)]
    # Restarted from its checkpoint weeks later: old epochs are still known, one row comes late itself.
    put(spark, src, [(1, day(30), 1), (3, day(30), 9), (2, day(1), 8)], EPOCHS, "b")
    again = run_ledger(stream_of(spark, src, EPOCHS), "epoch", "id", base)
    assert sorted((r.epoch, r.id) for r in again.where("accepted").collect()) == [(1, 3), (2, 4), (3, 9)]
    assert sorted((r.epoch, r.id) for r in again.where("not accepted").collect()) == [(1, 1), (1, 5), (2, 8)]


def test_hot_key_and_nulls_on_any_split(spark, tmp_path):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.5 else rng.randrange(40), None, i) for i in range(400)] + [(None, None, 1000), (None, None, 1001)]
    src = str(tmp_path / "in")
    for at in range(0, len(rows), 150):
        put(spark, src, rows[at : at + 150], EPOCHS, f"f{at}")
    out = run_ledger(stream_of(spark, src, EPOCHS, 1), "epoch", "id", str(tmp_path / "out"), salts=4).collect()
    assert len(out) == len(rows) and sorted(r.id for r in out) == sorted(r[2] for r in rows)
    taken = [r.epoch for r in out if r.accepted]
    assert len(taken) == len(set(taken)) == len({r[0] for r in rows})


FEATS = "r_pi double, r_fi double, d_np double, ok boolean"


def feature_rows(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal([20, 0.98, 5e6], [2, 0.01, 10], (n, 3))
    return [(*map(float, v), bool(rng.random() < 0.8)) for v in x] + [(math.inf, 1.0, 1.0, True), (1.0, None, 1.0, True), (1.0, 0.1, 9e6, False)]


@pytest.mark.parametrize("files", [1, 5])
def test_learned_thresholds_equal_those_of_one_pass(spark, tmp_path, files):
    rows = feature_rows(300, files)
    src = str(tmp_path / "in")
    size = -(-len(rows) // files)
    for i in range(files):
        put(spark, src, rows[i * size : (i + 1) * size], FEATS, f"f{i}")
    snaps, verdicts = learn.learn_and_detect(stream_of(spark, src, FEATS, 1), F.col("ok"), str(tmp_path / "out"))
    assert snaps.versions() == list(range(files))
    got = learn.thresholds_of(snaps.latest())
    want = J.fit_thresholds(spark.createDataFrame(rows, FEATS).where("ok"))
    assert got.n_rows == want.n_rows
    for c in learn.FEATURES:
        assert getattr(got, c) == pytest.approx(getattr(want, c), rel=1e-9)
    # Every verdict follows from the snapshot that it names.
    judged = verdicts.collect()
    assert len(judged) == len(rows) and {r.version for r in judged} == set(range(files))
    for v in range(files):
        th = learn.thresholds_of(snaps.at(v))
        for r in judged:
            if r.version == v and r.r_fi is not None:
                assert r.suspicious == (r.r_pi < th.r_pi and r.r_fi < th.r_fi and r.d_np > th.d_np)


def test_learning_goes_on_after_a_restart_and_a_batch_run_again_changes_nothing(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    rows = feature_rows(80, 3)
    put(spark, src, rows[:50], FEATS, "a")
    learn.learn_and_detect(stream_of(spark, src, FEATS), F.col("ok"), base)
    put(spark, src, rows[50:], FEATS, "b")
    snaps, _ = learn.learn_and_detect(stream_of(spark, src, FEATS), F.col("ok"), base)
    last = snaps.versions()[-1]
    want = sorted(map(tuple, snaps.latest().collect()))
    assert sum(n for _, n, *_ in want) == 3 * J.fit_thresholds(spark.createDataFrame(rows, FEATS).where("ok")).n_rows
    snaps.add(last, learn.moments(spark.createDataFrame(rows[50:], FEATS).where("ok")))
    # Sums of another layout may differ in the last bits.
    for a, b in zip(sorted(map(tuple, snaps.latest().collect())), want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)
    one = J.fit_thresholds(spark.createDataFrame(rows, FEATS).where("ok"))
    assert learn.thresholds_of(snaps.latest()).d_np == pytest.approx(one.d_np, rel=1e-9)


def test_no_rows_and_no_normal_rows(spark, tmp_path):
    empty = str(tmp_path / "none")
    put(spark, empty, [], FEATS, "a")
    snaps, verdicts = learn.learn_and_detect(stream_of(spark, empty, FEATS), F.col("ok"), str(tmp_path / "o1"))
    assert verdicts.count() == 0
    odd = str(tmp_path / "odd")
    put(spark, odd, [(1.0, 1.0, 1.0, False)], FEATS, "a")
    snaps, verdicts = learn.learn_and_detect(stream_of(spark, odd, FEATS), F.col("ok"), str(tmp_path / "o2"))
    assert [r.suspicious for r in verdicts.collect()] == [False] and snaps.latest().count() == 3

"""Rules for odd tables: NULL labels, repeated keys, clashing names, equal file names, layouts, wide tables."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowloom.functions import wavelet as V
from flowloom.operators import audit as A
from flowloom.operators import labels as L
from flowloom.operators import sampling as S
from flowloom.operators import stats as E
from flowloom.plans.prepare import prepare_dataset
from flowloom.sources import parquet as P


@pytest.fixture(scope="module")
def some_null(spark):
    label = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "A").otherwise("B")
    return spark.range(1000).select(F.col("id").alias("k"), label.alias("label"), (F.col("id") * 1.5).alias("x"))


@pytest.mark.parametrize("use", [
    lambda df: L.encode_labels(df, "label"), lambda df: S.subsample(df, "k", "label", 500), lambda df: S.stratified_split(df, "k", "label"),
    lambda df: prepare_dataset(df, "k", "label", ["x"]).scaled, lambda df: S.subsample_report(df, "label", 500),
])
def test_null_labels_fail(some_null, use):
    with pytest.raises(PySparkException, match="NULL in label"):
        use(some_null).collect()


def test_null_labels_still_count(some_null):
    counts = {r.label: r.n for r in L.class_counts(some_null, "label").collect()}
    assert counts[None] == 100 and sum(counts.values()) == 1000
    assert L.label_profile(some_null, "label").count() == 3


def test_repeated_keys_fail_where_they_change_sizes(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), F.lit("A").alias("label"))
    with pytest.raises(PySparkException, match="not unique"):
        S.stratified_split(df, "k", "label").collect()
    with pytest.raises(PySparkException, match="not unique"):
        S.plain_sample(df, "k", 505).collect()


def test_merge_beside_columns_called_src_and_dst(spark):
    df = spark.createDataFrame([(1, "a", "x", "y"), (2, "b", "x", "y")], "k int, label string, src string, DST string")
    got = L.merge_labels(df, "label", {"a": "b"}).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "b", "x", "y"), (2, "b", "x", "y")]


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, n in (("d1", 3), ("d2", 5)):
        spark.range(n).select(F.when(F.col("id") > 0, F.lit("A")).alias("label")).coalesce(1).write.parquet(str(tmp_path / folder))
        (part,) = (tmp_path / folder).glob("part-*.parquet")
        part.rename(tmp_path / folder / "part-0.parquet")
    prof = P.file_profile(spark, str(tmp_path)).collect()
    assert sorted((r.file, r.n_rows, r.n_files) for r in prof if r.file) == [("part-0.parquet", 3, 1), ("part-0.parquet", 5, 1)]
    assert [(r.n_rows, r.n_files) for r in prof if r.file is None] == [(8, 2)]
    df = P.scan_flows(spark, str(tmp_path))
    ok = L.label_count_reconcile(df, "label", P.rows_by_file(df)).collect()
    assert sorted((r.n_rows, r.n_labels, r.ok) for r in ok) == [(3, 2, False), (5, 4, False)]


@pytest.mark.parametrize("parts", [3, 16])
def test_subbands_do_not_depend_on_the_layout(spark, parts):
    g = V.geometry(48)
    x = np.random.default_rng(4).random((1000, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_key long, features array<double>")
    bands = lambda d: {r.row_key: r.subbands for r in V.with_subbands(d, "features", g).collect()}
    assert bands(df.repartition(1)) == bands(df.repartition(parts).sortWithinPartitions(F.rand(1)))


def test_81_columns(spark):
    cols = [f"c {i}" for i in range(81)]
    df = spark.range(500).select("id", *[F.when(F.col("id") % (i + 2) == 1, float("nan")).otherwise(F.col("id") * (i + 1.0)).alias(c) for i, c in enumerate(cols)])
    stats = E.scaler_stats(E.column_stats(df, cols, split=None))
    want = {c: [k * (i + 1.0) for k in range(500) if k % (i + 2) != 1] for i, c in enumerate(cols)}
    for r in stats.collect():
        v = want[r.column]
        assert (r.n_rows, r.n_finite, r.min, r.max) == (500, len(v), min(v), max(v)) and r.mean == pytest.approx(np.mean(v))
    scaled = E.minmax_scale(df, E.Scaler.collect(stats)).orderBy("id").collect()
    for i in (0, 1, 40, 80):
        v = want[cols[i]]
        assert scaled[4][f"c {i}"] == pytest.approx(4.0 * (i + 1) / max(v) if 4 % (i + 2) != 1 else np.mean(v) / max(v), rel=1e-6)


def test_statistics_of_no_rows(spark):
    rows = E.column_stats(spark.createDataFrame([], "a double, b int"), ["a", "b"], split=None).collect()
    assert [(r.column, r.n_rows, r.n_finite, r.n_missing, r.total, r.min, r.max) for r in sorted(rows)] == [("a", 0, 0, 0, 0.0, None, None), ("b", 0, 0, 0, 0.0, None, None)]


def test_exact_percentiles(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=501), "b": np.repeat([-3.0, 0.0, 7.0], [5, 1, 4]), "c": rng.exponential(1e-9, 40), "d": np.array([2.5])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None)], "g string, v double").repartition(5)
    for r in A.exact_percentiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.95, 1.0]).collect():
        assert r.result == pytest.approx(np.quantile(groups[r.g], r.share), rel=1e-12, abs=1e-15)

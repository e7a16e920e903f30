"""Column fingerprints next to the statistics: what they tell apart, and what they leave to a comparison."""

import math

import pytest
from pyspark.sql import functions as F

from flowloom.operators import stats as E

NAN, INF = math.nan, math.inf


def prints(df, columns):
    return {r.column: r.fingerprint for r in E.column_stats(df, columns, split=None, key="k").collect()}


def table_of(spark):
    rows = [(i, float(i % 50), float((i + 1) % 50), [NAN, INF, None][i % 3] if i % 7 == 0 else i / 8, [None, NAN, -INF][i % 3] if i % 7 == 0 else i / 8) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, a double, moved double, holes double, other_holes double")
    return df.withColumn("same", F.col("a") + 0.0).withColumn("zero", F.when(F.col("a") == 0, -0.0).otherwise(F.col("a")))


def test_equal_columns_agree_and_others_do_not(spark):
    p = prints(table_of(spark), ["a", "same", "zero", "moved", "holes", "other_holes"])
    assert p["a"] == p["same"] == p["zero"] and p["holes"] == p["other_holes"]
    assert len({p["a"], p["moved"], p["holes"]}) == 3


@pytest.mark.parametrize("parts", [1, 7])
def test_same_for_any_layout(spark, parts):
    df = table_of(spark)
    assert prints(df.repartition(parts), ["a", "holes"]) == prints(df, ["a", "holes"])


def test_columns_with_equal_statistics_are_told_apart_without_a_scan(spark):
    df = table_of(spark).select("k", "a", "moved", "same")
    plain = E.scaler_stats(E.column_stats(df, ["a", "moved", "same"], split=None))
    marked = E.scaler_stats(E.column_stats(df, ["a", "moved", "same"], split=None, key="k"))
    assert {r.column for r in E.duplicate_candidates(plain).collect()} == {"moved", "same"}
    assert {r.column for r in E.duplicate_candidates(marked).collect()} == {"same"}
    assert {(r.column, r.evidence) for r in E.column_drop_report(marked, df).collect()} == {("same", "a")}


def test_agreeing_fingerprints_are_still_compared(spark):
    df = table_of(spark)
    stats = E.scaler_stats(E.column_stats(df, ["a", "moved"], split=None, key="k")).withColumn("fingerprint", F.lit("1:1"))
    assert [r.column for r in E.duplicate_candidates(stats).collect()] == ["moved"]
    assert E.column_drop_report(stats, df).collect() == []


def test_comparison_on_drawn_rows(spark):
    """One row that differs is seen among all rows and, at a small draw, only if it is drawn."""
    df = table_of(spark).select("k", "a", F.when(F.col("k") == 17, -1.0).otherwise(F.col("a")).alias("b"))
    pair = spark.createDataFrame([(1, "b", "a")], "ordinal int, column string, keeper string")
    drawn = {r.k for r in E.plain_sample(df, "k", 20).collect()}
    assert len(drawn) == 20
    assert E.drop_duplicate_columns(df, pair).collect() == []
    assert len(E.drop_duplicate_columns(df, pair, 20, "k").collect()) == (17 not in drawn)
    assert E.drop_duplicate_columns(df, pair, 5000, "k").collect() == []
    with pytest.raises(ValueError, match="row key"):
        E.drop_duplicate_columns(df, pair, 20)


def test_no_rows(spark):
    assert len(set(prints(table_of(spark).limit(0), ["a", "holes"]).values())) == 1


def test_matrix_form_scales_the_same(spark):
    df = table_of(spark)
    names = ["a", "moved", "holes"]
    scaler = E.Scaler.collect(E.scaler_stats(E.column_stats(df, names, split=None)).where("column <> 'moved'"))
    want = E.minmax_scale(df.select("k", *names), scaler).select("k", "a", "holes").orderBy("k").collect()
    packed = df.select("k", E.as_matrix(names).alias("m"))
    got = E.minmax_scale(packed, scaler, "m", names)
    assert got.columns == ["k", "a", "holes"] and got.orderBy("k").collect() == want
    assert E.column_stats(packed, names, split=None, matrix="m").collect() == E.column_stats(df, names, split=None).collect()

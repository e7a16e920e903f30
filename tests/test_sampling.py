import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import labels as L
from flowloom.operators import ranking as R
from flowloom.operators import sampling as S
from flowloom.operators.bounds import bounded, pinned

# Published class counts of the flow dataset after merging synonyms.
PUBLISHED = [20082580, 6473789, 5787453, 5159870, 5071011, 4522492, 4093279, 3867155, 3657497, 3134645,
             2610611, 2179930, 1915122, 1202642, 368334, 186960, 113828, 439]


def table(spark, counts):
    rows = [(i, c) for i, c in enumerate(c for c, n in counts.items() for _ in range(n))]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "row_key long, label string")


def md5(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def test_published_cap(spark):
    counts = spark.createDataFrame([(n,) for n in PUBLISHED], "n long")
    assert S.class_cap(counts, 10_000_000).first().cap == 666_460
    assert sum(min(n, 666_460) for n in PUBLISHED) == 10_000_001
    assert S.class_cap(counts, 10**9).first().cap == max(PUBLISHED)


def test_cap_is_the_smallest(spark):
    rng = random.Random(1)
    for _ in range(12):
        counts = [rng.randint(1, 60) for _ in range(rng.randint(1, 8))]
        target = rng.randint(1, sum(counts) + 10)
        want = max(counts) if sum(counts) <= target else next(c for c in range(1, 99) if sum(min(n, c) for n in counts) >= target)
        assert S.class_cap(spark.createDataFrame([(n,) for n in counts], "n long"), target).first().cap == want


def test_capped_and_proportional_sizes(spark):
    df = table(spark, {"a": 400, "b": 90, "c": 5})
    capped = dict(S.subsample(df, "row_key", "label", 200, "capped").groupBy("label").count().collect())
    assert capped["c"] == 5 and capped["b"] == 90 and sum(capped.values()) in (200, 201)
    prop = dict(S.subsample(df, "row_key", "label", 50, "proportional").groupBy("label").count().collect())
    assert prop == {"a": round(400 * 50 / 495), "b": round(90 * 50 / 495), "c": 1}
    assert S.subsample(df, "row_key", "label", 10_000, "capped").count() == 495
    with pytest.raises(ValueError):
        S.subsample(df, "row_key", "label", 10, "other")
    report = {r["class"]: r for r in S.subsample_report(df, "label", 200).collect()}
    assert report["c"].kept_whole and not report["a"].kept_whole and report["a"].total_before == 495


def test_split_sizes_order_and_layout(spark):
    df = table(spark, {"a": 1000, "b": 333, "c": 7, "d": 1})
    got = {r.row_key: r.split for r in S.stratified_split(df, "row_key", "label").collect()}
    again = {r.row_key: r.split for r in S.stratified_split(df.repartition(7), "row_key", "label", seed=42).collect()}
    other = {r.row_key: r.split for r in S.stratified_split(df, "row_key", "label", seed=43).collect()}
    assert got == again and got != other
    by_class = {}
    for r in df.collect():
        by_class.setdefault(r.label, []).append(r.row_key)
    for keys in by_class.values():
        n = len(keys)
        n_test = round(n * 0.3)
        n_val = round((n - n_test) * 0.15)
        keys.sort(key=lambda k: md5(42, k))
        want = ["test"] * n_test + ["val"] * n_val + ["train"] * (n - n_test - n_val)
        assert [got[k] for k in keys] == want


def test_published_split_shares(spark):
    df = table(spark, {"BENIGN": 600, "Syn": 3000, "TFTP": 2100, "WebDDoS": 300})
    report = S.assert_no_leakage(S.stratified_split(df, "row_key", "label"), "row_key").first()
    assert report.frac_train == pytest.approx(0.595, abs=0.01)
    assert report.frac_val == pytest.approx(0.105, abs=0.01)
    assert report.frac_test == pytest.approx(0.30, abs=0.01)
    per = S.split_class_counts(S.stratified_split(df, "row_key", "label"), "label").collect()
    assert all(r.test == pytest.approx(0.3 * (r.train + r.val + r.test), abs=1) for r in per)


def test_leakage_is_an_error(spark):
    bad = spark.createDataFrame([(1, "train"), (1, "test"), (2, "val")], "row_key long, split string")
    assert S.split_leakage(bad, "row_key").first().overlap_train_test == 1
    with pytest.raises(Exception, match="overlap"):
        S.assert_no_leakage(bad, "row_key").collect()


def test_narrowing_gives_the_same_cuts(spark):
    df = table(spark, {"a": 3000, "b": 40})
    limits = lambda n: [F.rint(n * 0.3), F.rint(n * 0.5)]
    plain = R.hash_cuts(df, "row_key", 1, limits, group="label")
    narrow = R.hash_cuts(df, "row_key", 1, limits, group="label", digits=1, rank_rows=2)
    assert sorted(plain.collect()) == sorted(narrow.collect())


def test_repeated_keys_are_an_error(spark):
    df = spark.range(100).select(F.lit(5).alias("row_key"), F.lit("a").alias("label"))
    with pytest.raises(ValueError, match="unique"):
        R.hash_cuts(df, "row_key", 1, lambda n: [n / 2], group="label", rank_rows=10)


def test_rank_equals_one_window(spark):
    df = table(spark, {"a": 700, "b": 30})
    want = {}
    for label in ("a", "b"):
        keys = sorted((r.row_key for r in df.filter(F.col("label") == label).collect()), key=lambda k: md5(9, k))
        want |= {k: i + 1 for i, k in enumerate(keys)}
    got = {r.row_key: r["rank"] for r in R.hash_rank(df, "row_key", 9, group="label").collect()}
    assert got == want


def test_group_split_keeps_groups_together(spark):
    # one group holds a third of all rows
    df = spark.range(3000).select(F.col("id").alias("row_key"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("grp"))
    out = S.group_split(df, "grp")
    assert out.count() == 3000
    assert out.groupBy("grp").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    sizes = dict(out.select("grp", "split").distinct().groupBy("split").count().collect())
    assert sizes == {"test": 15, "val": 5, "train": 30}


def test_first_rows(spark):
    keys = [5, 1, 10**12, 7, 3, 10**9, 2]
    df = spark.createDataFrame([(k,) for k in keys], "row_key long")
    assert [r.row_key for r in S.first_rows(df, "row_key", 4).collect()] == [1, 2, 3, 5]
    assert S.first_rows(df, "row_key", 100).count() == 7
    assert S.first_rows(df.filter("row_key < 0"), "row_key", 3).count() == 0


def test_batches(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_key")
    b = S.epoch_batches(df, "row_key", 128, epoch=1)
    assert b.select("batch_id").distinct().count() == 8 and b.select("row_key").distinct().count() == 1000
    full = {(r.row_key, r.batch_id) for r in b.collect()}
    rest = {(r.row_key, r.batch_id) for r in S.resume_batches(b, 3).collect()}
    assert rest == {x for x in full if x[1] >= 3} and len(rest) == 1000 - 3 * 128
    assert S.epoch_batches(df, "row_key", 128, epoch=1, drop_last=True).count() == 7 * 128
    assert {(r.row_key, r.batch_id) for r in S.epoch_batches(df, "row_key", 128, epoch=2).collect()} != full


def test_plain_sample(spark):
    df = spark.range(500).withColumnRenamed("id", "row_key")
    assert S.plain_sample(df, "row_key", 30).select("row_key").distinct().count() == 30
    assert S.plain_sample(df, "row_key", 900).count() == 500


# ------------------------------------------------------------------ labels
def test_merge_and_encode(spark):
    df = table(spark, {"BENIGN": 10, "UDP-lag": 30, "UDPLag": 5, "Syn": 20})
    assert L.class_table(df, "label").count() == 4
    merged = L.merge_labels(df, "label", {"UDP-lag": "UDPLag"})
    assert [(r.label, r.code) for r in L.class_table(merged, "label").orderBy("code").collect()] == [("BENIGN", 0), ("Syn", 1), ("UDPLag", 2)]
    assert {(r.label, r.code) for r in L.class_constants(merged, "label").collect()} == {(r.label, r.code) for r in L.class_table(merged, "label").collect()}
    assert dict(L.class_counts(merged, "label").collect())["UDPLag"] == 35
    audit = {r["class"]: r for r in L.label_merge_audit(df, "label", {"UDP-lag": "UDPLag"}).collect()}
    assert (audit["UDPLag"].n, audit["UDPLag"].n_merged, audit["UDPLag"].merged_from) == (35, 30, "UDP-lag")
    with pytest.raises(ValueError, match="nope"):
        L.merge_labels(df, "label", {"nope": "Syn"})


def test_benign_required(spark):
    df = table(spark, {"Benign": 2, "Syn": 3})
    assert L.benign_class(L.class_table(df, "label"), "label").first().label == "Benign"
    with pytest.raises(Exception, match="no class named"):
        L.benign_class(L.class_table(df.filter("label = 'Syn'"), "label"), "label").collect()


def test_strip(spark):
    df = spark.createDataFrame([("  Syn \t",), (" x y ",)], "label string")
    assert [r.label for r in L.strip_labels(df, "label").collect()] == ["Syn", "x y"]


def test_bounds(spark):
    assert bounded(spark.range(5), 5, "t").count() == 5
    with pytest.raises(Exception, match="more than 4"):
        bounded(spark.range(5), 4, "t").collect()
    with pytest.raises(ValueError, match="more than 4"):
        pinned(spark.range(5), "t", 4)

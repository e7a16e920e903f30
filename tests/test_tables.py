"""Statistics, preparation, sources, audit, counters, streams, attribution."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowloom.functions import wavelet as V
from flowloom.operators import anomaly as J
from flowloom.operators import attribution as I
from flowloom.operators import audit as A
from flowloom.operators import scoring as K
from flowloom.operators import stats as E
from flowloom.plans.prepare import prepare_dataset
from flowloom.sources import parquet as P
from flowloom.sources import sinks as W
from flowloom.streaming import detect as D

NAN, INF = float("nan"), float("inf")


# ------------------------------------------------------------------ sources
@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    """Three files of a capture with blanks in names, identifiers, missing, infinite and constant values."""
    path = str(tmp_path_factory.mktemp("flows"))
    rng = np.random.default_rng(0)
    labels = rng.choice(["BENIGN", "Syn", "TFTP", "WebDDoS"], 1500, p=[0.1, 0.5, 0.35, 0.05])
    rows = []
    for i in range(1500):
        f = [float(v) for v in rng.normal(range(6), 2)]
        f[0] = NAN if i % 75 == 0 else INF if i % 300 == 1 else f[0]
        f[1] = 7.0
        rows.append((i, "flow", "1.1.1.1", 0, i, *f, f[2], f" {labels[i]} "))
    names = ["Unnamed: 0", " Flow ID", " Source IP", "__source_file_id", "__source_row_id", *[f" Feat{i}" for i in range(6)], " FeatDup", " Label"]
    kinds = ["long", "string", "string", "long", "long", *["double"] * 7, "string"]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path, mode="overwrite")
    return path


def test_discovery(spark, dirty):
    df = P.scan_flows(spark, dirty)
    s = P.discover_schema(df)
    assert s.label == " Label" and len(s.features) == 7
    assert {d[0]: d[2] for d in s.dropped}["__source_row_id"] == "provenance"
    assert {d[0]: d[2] for d in s.dropped}[" Flow ID"] == "identifier"
    with pytest.raises(ValueError, match="none of the label"):
        P.discover_schema(df.drop(" Label"))
    with pytest.raises(ValueError, match="not numeric"):
        P.discover_schema(df.withColumn("proto", F.lit("tcp")))
    with pytest.raises(ValueError):
        s.pruned([(f, "double", "x") for f in s.features])
    assert " Flow ID" not in P.drop_identifiers(df).columns
    assert P.normalised(df).columns[-1] == "label"


def test_missing_path_fails(spark, tmp_path):
    with pytest.raises(Exception):
        P.scan_flows(spark, str(tmp_path / "none")).count()


def test_file_tables(spark, dirty):
    prof = P.file_profile(spark, dirty, "part-*.parquet").collect()
    total = [r for r in prof if r.file is None][0]
    assert (total.n_rows, total.n_files) == (1500, 3) and total.bytes > 0
    assert P.distinct_schemas(spark, dirty).count() == 1
    bad = P.schema_consistency(spark, dirty, [" Label", "gone"]).collect()
    assert len(bad) == 3 and all(r.missing == "gone" for r in bad)


def test_file_profile_counts_bytes_and_rows_of_nested_folders(spark, tmp_path):
    sizes = {"a/x.parquet": 10, "b/x.parquet": 25, "b/c/y.parquet": 0}
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"v": pa.array(range(n), pa.int64())}), tmp_path / name, row_group_size=10)
    prof = P.file_profile(spark, str(tmp_path)).collect()
    got = sorted((r.file, r.n_rows, r.bytes, r.n_row_groups, r.n_files) for r in prof if r.file)
    size = {name: (tmp_path / name).stat().st_size for name in sizes}
    groups = {name: pq.ParquetFile(tmp_path / name).metadata.num_row_groups for name in sizes}
    assert got == sorted((name.split("/")[-1], n, size[name], groups[name], 1) for name, n in sizes.items())
    total = [r for r in prof if r.file is None]
    assert [(r.n_rows, r.bytes, r.n_row_groups, r.n_files) for r in total] == [(35, sum(size.values()), sum(groups.values()), 3)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables as files and as folders of parts, below a folder whose name needs encoding."""
    path = tmp_path_factory.mktemp("x.parquet") / "a+b %20 c"
    spark.range(30).select("id", F.col("id").alias("y")).repartition(3).write.parquet(str(path / "a.parquet"))
    spark.range(20).select("id", F.col("id").alias("day")).repartition(4).write.parquet(str(path / "deep" / "a.parquet"))
    pq.write_table(pa.table({"id": [1, 2], "v": [1.0, 2.0]}), path / "b.parquet")
    pq.write_table(pa.table({"id": pa.array([], pa.int64())}), path / "none.parquet")
    return str(path)


def test_parts_of_a_table_are_counted_as_one_artifact(spark, tables):
    counted = P.rows_by_dataset(spark, tables)
    root = f"file:{tables}"
    assert sorted((r.path, r.file, r.n_rows) for r in counted.collect()) == [
        (f"{root}/a.parquet", "a.parquet", 30), (f"{root}/b.parquet", "b.parquet", 2), (f"{root}/deep/a.parquet", "a.parquet", 20),
    ]
    found = A.artifact_presence(counted, ["a.parquet", "b.parquet", "none.parquet", "gone.parquet"])
    assert sorted(tuple(r) for r in found.collect()) == [
        ("a.parquet", True, 50), ("b.parquet", True, 2), ("gone.parquet", False, 0), ("none.parquet", False, 0),
    ]


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """Tables as files and as folders of parts, one part with a name of its own."""
    path = tmp_path_factory.mktemp("parted")
    spark.range(30).select("id", F.col("id").alias("y")).repartition(3).write.parquet(str(path / "a.parquet"))
    spark.range(20).select("id", F.col("id").alias("y")).repartition(4).write.parquet(str(path / "deep" / "a.parquet"))
    pq.write_table(pa.table({"id": [1, 2]}), path / "a.parquet" / "000000_0")
    pq.write_table(pa.table({"id": [1, 2], "v": [1.0, 2.0]}), path / "b.parquet")
    pq.write_table(pa.table({"w": pa.array([], pa.int64())}), path / "none.parquet")
    (path / "notes.txt").write_text("no table")
    return str(path)


def test_profile_adds_up_the_parts_of_a_table(spark, parted):
    got = [(r.file, r.n_rows, r.n_row_groups, r.n_files) for r in P.file_profile(spark, parted).collect()]
    assert sorted(got, key=str) == sorted([
        ("a.parquet", 32, 4, 1), ("a.parquet", 20, 4, 1), ("b.parquet", 2, 1, 1), ("none.parquet", 0, 1, 1), (None, 54, 10, 4),
    ], key=str)
    one = P.file_profile(spark, parted, "b.parquet").collect()
    assert sorted((r.file or "", r.n_rows, r.n_files) for r in one) == [("", 2, 1), ("b.parquet", 2, 1)]
    parts = P.file_profile(spark, f"{parted}/a.parquet", "*0*").collect()
    assert [(r.n_rows, r.n_files) for r in parts if r.file is None] == [(32, 4)]


def test_columns_that_any_part_of_a_table_lacks(spark, parted):
    rows = P.schema_consistency(spark, parted, ["v", "id", "y"]).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("a.parquet", 1, "v"), ("a.parquet", 2, "v,y"), ("b.parquet", 1, "y"), ("none.parquet", 3, "id,v,y"),
    ]


def test_column_lists_count_a_table_once(spark, parted):
    rows = P.distinct_schemas(spark, parted).collect()
    assert sorted(tuple(r) for r in rows) == [("id", 1, 2), ("id,v", 1, 2), ("id,y", 2, 50), ("w", 1, 0)]


@pytest.mark.parametrize("path, root, pattern, want", [
    ("file:/d/s/t.parquet/p=1/part-0.parquet", "/d/s", "*.parquet", "file:/d/s/t.parquet"),
    ("file:/d/s/t.parquet/part-0", "file:///d/s/", "t.parquet", "file:/d/s/t.parquet"),
    ("file:/d.parquet/s/t.parquet", "/d.parquet/s", "*.parquet", "file:/d.parquet/s/t.parquet"),
    ("file:/d.parquet/part-0.parquet", "/d.parquet", "*.parquet", "file:/d.parquet/part-0.parquet"),
    ("viewfs://store/in/s1/t.parquet/x", "viewfs://store/in/s?", "{t,u}.parquet", "viewfs://store/in/s1/t.parquet"),
    ("file:/home/me/s/t.parquet/x", "./s", "[!a]*.parquet", "file:/home/me/s/t.parquet"),
    ("file:/d/s/t.parquet", "/d/s/t.parquet", "*.parquet", "file:/d/s/t.parquet"),
    ("file:/d/s/notes.txt", "/d/s", "*.parquet", None),
    ("file:/d/s/u.parquet/part-0.parquet", "/d/s", "t.parquet", None),
])
def test_table_of_a_file(spark, path, root, pattern, want):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(P.dataset_of(F.col("path"), root, pattern)).first()[0] == want


def test_prepare_end_to_end(spark, dirty, tmp_path):
    df = P.scan_flows(spark, dirty)
    s = P.discover_schema(df)
    df = df.withColumn("row_key", F.col("`__source_row_id`")).withColumn("y", F.trim(F.col("` Label`")))
    p = prepare_dataset(df, "row_key", "y", s.features, merge={"WebDDoS": "TFTP"}, target_rows=1200)
    drops = {r.column: (r.reason, r.evidence) for r in p.drops.collect()}
    assert drops == {" Feat1": ("constant_on_train", "7.0"), " FeatDup": ("duplicate_of", " Feat2")}
    back = W.write_feature_table(p.scaled, str(tmp_path / "features"), partition_by=["split"])
    assert 1200 <= back.count() <= 1203 and set(p.scaler.columns) == {" Feat0", " Feat2", " Feat3", " Feat4", " Feat5"}
    vals = np.array([r.v for r in E.assemble_vector(back, p.scaler.columns, "v").select("v").collect()])
    assert vals.min() >= 0 and vals.max() <= 1
    train = np.array([r.v for r in E.assemble_vector(back.filter("split = 'train'"), p.scaler.columns, "v").select("v").collect()])
    assert train.min(axis=0) == pytest.approx(np.zeros(5)) and train.max(axis=0) == pytest.approx(np.ones(5))


def test_stats_use_train_rows_only(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (NAN, "train"), (INF, "train"), (100.0, "test")], "x double, split string")
    s = E.scaler_stats(E.column_stats(df, ["x"])).first()
    assert (s.n_rows, s.n_finite, s.n_missing, s.min, s.max, s.mean, s.missing_ratio) == (4, 2, 2, 1.0, 3.0, 2.0, 0.5)
    scaler = E.Scaler.collect(E.scaler_stats(E.column_stats(df, ["x"])))
    got = [r.x for r in E.minmax_scale(df, scaler).collect()]
    assert got == [0.0, 1.0, 0.5, 0.5, 1.0]


def test_many_columns_match_few(spark):
    names = [f"c{i}" for i in range(83)]
    df = spark.range(50).select(*[(F.col("id") * (i + 1)).cast("double").alias(c) for i, c in enumerate(names)])
    out = {r.column: r for r in E.column_stats(df, names, split=None).collect()}
    assert len(out) == len(names) and out[names[-1]].max == 49.0 * len(names)
    assert [r.ordinal for r in sorted(out.values(), key=lambda r: r.ordinal)] == list(range(len(names)))


def test_all_missing_column_and_thresholds(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0)], "a double, b double")
    s = E.scaler_stats(E.column_stats(df, ["a", "b"], split=None))
    assert {r.column: r.missing_ratio for r in s.collect()} == {"a": 1.0, "b": 0.0}
    rep = E.column_drop_report(s, df).orderBy("step").collect()
    assert [(r.column, r.reason) for r in rep] == [("a", "missing_ratio_above_threshold"), ("b", "constant_on_train")]


def test_duplicates_need_equal_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, 2.0, 1.0), (3.0, 3.0, 2.0)], "a double, b double, c double")
    s = E.scaler_stats(E.column_stats(df, ["a", "b", "c"], split=None))
    assert {r.column for r in E.duplicate_candidates(s).collect()} == {"b", "c"}
    assert {(r.column, r.evidence) for r in E.column_drop_report(s, df).collect()} == {("b", "a")}


def test_csv_and_union(spark, tmp_path):
    df = spark.createDataFrame([(1, 1 / 3), (2, NAN), (3, INF)], "k int, v double")
    W.write_csv(df, str(tmp_path / "csv"))
    text = "".join(sorted(p.read_text() for p in (tmp_path / "csv").glob("*.csv")))
    assert "1,0.333333" in text and "2,\n" in text and "3,\n" in text
    u = W.union_fields([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "a int, c int")])
    assert sorted(tuple(r) for r in u.collect()) == [("1", "2", ""), ("3", "", "4")]


def test_fingerprint_depends_on_order_and_values(spark):
    mk = lambda rows: W.schema_fingerprint(spark.createDataFrame(rows, "ordinal int, column string, min double, max double, mean double"), " Label").first()
    a = mk([(0, "x", 0.0, 1.0, 0.5), (1, "y", 0.0, 1.0, 0.5)])
    assert a == mk([(1, "y", 0.0, 1.0, 0.5), (0, "x", 0.0, 1.0, 0.5 + 1e-12)])
    assert a.schema_hash != mk([(0, "y", 0.0, 1.0, 0.5), (1, "x", 0.0, 1.0, 0.5)]).schema_hash
    assert a.scaler_hash != mk([(0, "x", 0.0, 1.0, 0.6), (1, "y", 0.0, 1.0, 0.5)]).scaler_hash


# ------------------------------------------------------------------ audit
def hist(spark, epochs, sessions=None):
    sessions = sessions or ["s"] * len(epochs)
    return spark.createDataFrame(list(zip(epochs, sessions)), "epoch int, session_id string")


def test_history_checks(spark):
    assert [r.epoch for r in A.session_boundaries(hist(spark, [1, 2, 3, 4, 5], ["s1", "s1", "s2", "s2", "s3"])).collect()] == [3, 5]
    assert [(r.epoch, r.problem) for r in A.sequence_gaps(hist(spark, [1, 3])).collect()] == [(2, "missing")]
    assert A.sequence_gaps(hist(spark, [1, 2, 3])).count() == 0
    ok = A.append_unique(hist(spark, [1, 2]), hist(spark, [3]))
    assert ok.count() == 3
    with pytest.raises(Exception, match="already in the history"):
        A.append_unique(hist(spark, [1, 2]), hist(spark, [2])).collect()
    assert A.append_violations(hist(spark, [1, 2]), hist(spark, [2, 3])).first().epoch == 2


def test_stall(spark):
    log = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 6)], "i int, p int")
    assert [r.stalled for r in A.stall_detect(log, "i", "p").orderBy("i").collect()] == [False, False, True, False]


def test_prediction_diff(spark):
    mk = lambda rows: spark.createDataFrame(rows, "row_key int, y_prob array<float>")
    a = mk([(1, [0.5, 0.5]), (2, [1.0, 0.0])])
    assert A.prediction_diff(a, a).first().ok
    far = A.prediction_diff(a, mk([(1, [0.5, 0.5]), (2, [0.9, 0.1])])).first()
    assert not far.ok and far.max_diff == pytest.approx(0.1)
    assert A.prediction_diff(a, mk([(1, [0.5, 0.5])])).first().n_one_sided == 1
    assert A.prediction_diff(a, mk([(1, [0.5]), (2, [1.0, 0.0])])).first().n_shape_differs == 1


def test_quality_report(spark):
    h = hist(spark, [1, 2, 4])
    n = F.count(F.lit(1))
    rep = A.quality_report([A.check_row(h, "a", F.max("epoch") != n), A.check_row(h, "b", F.max("epoch") > 9), A.check_row(h, "c", n > 0, n < 9)])
    got = {r.check_name: r.status for r in rep.collect() if r.check_name}
    assert got == {"a": "FAIL", "b": "PASS", "c": "SKIP"}
    assert {(r.status, r.n) for r in rep.collect() if not r.check_name} == {("FAIL", 1), ("PASS", 1), ("SKIP", 1)}


def test_latency(spark):
    df = spark.createDataFrame([(4, float(a), 1.0) for a in (1, 2, 4, 10)], "bs int, t1 double, t2 double")
    r = A.latency_percentiles(df, "bs", ["t1", "t2"], "t2").first()
    assert (r.t1_p50, r.t1_p95) == (3.0, pytest.approx(9.1))
    assert r.rows_per_second == pytest.approx(1000.0) and r.share_percent == pytest.approx(25.0)


# ------------------------------------------------------------------ counters
def switches(spark, n, attack=False, seed=0):
    rng = np.random.default_rng(seed)
    fi = rng.normal(1000, 50, n)
    pi = rng.normal(500, 30, n) if attack else rng.normal(50, 5, n)
    fo = fi * (rng.normal(0.30, 0.02, n) if attack else rng.normal(0.98, 0.005, n))
    pin = rng.normal(20000, 500, n)
    out = pin - (rng.normal(5000, 200, n) if attack else rng.normal(50, 10, n))
    rows = [tuple(map(float, r)) for r in zip(fi, fo, pi, pin, out)]
    return J.counter_features(spark.createDataFrame(rows, "n_fi double, n_fo double, n_packet_in_flows double, n_packets_in double, n_packets_out double"))


def test_counter_formulas(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(J.ratio_r_pi(lit(100), lit(10))) == 10 and one(J.ratio_r_fi(lit(80), lit(100))) == pytest.approx(0.8)
    assert one(J.delta_packets(lit(500), lit(420))) == 80
    assert one(J.ratio_r_pi(lit(5), lit(0))) == INF
    with pytest.raises(ValueError, match="N_PO"):
        J.counter_features(spark.createDataFrame([(1, 1, 1, 1)], "n_fi int, n_fo int, n_packet_in_flows int, n_packets_in int"))


def test_threshold_golden(spark):
    rows = [(20 - 2.0, 0.97, 40.0), (20 + 2.0, 0.99, 60.0), (INF, 1.0, 1.0)]
    t = J.sigma_thresholds(spark.createDataFrame(rows, "r_pi double, r_fi double, d_np double")).first()
    assert t.n_rows == 2
    assert (t.r_pi_threshold, t.r_fi_threshold, t.d_np_threshold) == (pytest.approx(14), pytest.approx(0.95), pytest.approx(80))
    with pytest.raises(Exception, match="need 10000"):
        J.sigma_thresholds(spark.createDataFrame(rows, "r_pi double, r_fi double, d_np double"), strict=True).collect()


def test_all_three_must_be_past(spark):
    th = J.Thresholds(14, 0.95, 80, 2)
    df = spark.createDataFrame([(10.0, 1.0, 1.0), (10.0, 0.5, 1.0), (10.0, 0.5, 100.0), (INF, 0.5, 100.0)], "r_pi double, r_fi double, d_np double")
    assert [r.suspicious for r in J.sigma_detect(df, th).collect()] == [False, False, True, False]


def test_detection_rates(spark):
    th = J.fit_thresholds(switches(spark, 10_000), strict=True)
    assert J.sigma_explain(switches(spark, 5000, attack=True, seed=1), th).first().all_three > 0.99
    assert J.sigma_explain(switches(spark, 5000, seed=2), th).first().all_three < 0.01


# ------------------------------------------------------------------ streams
def test_stream_drops_late_rows_and_open_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    day = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"
    mk = lambda rows: spark.createDataFrame(rows, "u int, ts string, kind string, v double").withColumn("ts", F.to_timestamp_ntz("ts"))
    mk([(1, day(1, 1), "view", 5.0), (1, day(1, 2), "error", 1.0), (1, day(3, 1), "view", 2.0)]).coalesce(1).write.parquet(src)
    th = J.Thresholds(100.0, 100.0, -1.0, 2)
    events = D.file_stream(spark, src)
    out = D.run_to_table(D.stream_detect(events, th, "u", "ts", "kind", "v"), "t").collect()
    assert [(r.switch, r.n_fi, r.n_packet_in_flows, r.suspicious) for r in out] == [(1, 1, 1, True)]


def test_stream_confusion_and_unique(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(0, i % 2), (1, 1)], "y_true int, y_pred int").coalesce(1).write.mode("append").parquet(src)
    snap = D.run_complete(D.stream_confusion(D.file_stream(spark, src)))
    assert {(r.y_true, r.y_pred): r.n for r in snap.collect()} == {(0, 0): 2, (0, 1): 1, (1, 1): 3}
    hot = str(tmp_path / "hot")
    spark.range(300).select((F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 7)).cast("int").alias("epoch"), F.current_timestamp().alias("ts"), "id").write.parquet(hot)
    got = D.run_to_table(D.stream_append_unique(D.file_stream(spark, hot), "epoch", "ts", "id"), "u")
    assert sorted(r.epoch for r in got.collect()) == list(range(7))


def test_stream_of_a_table_that_is_a_folder_of_parts(spark, tmp_path):
    spark.range(30).select("id", (F.col("id") % 3).cast("int").alias("y")).repartition(3).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "b.parquet"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "plain"))
    (part,) = (tmp_path / "plain").glob("part-*.parquet")
    part.rename(tmp_path / "c.parquet")
    rows = D.file_stream(spark, str(tmp_path), "a.parquet")
    assert rows.columns == ["id", "y"]
    assert sorted(r.id for r in D.run_to_table(rows, "folder").collect()) == list(range(30))
    assert D.run_to_table(D.file_stream(spark, str(tmp_path), "c.parquet"), "file").count() == 7
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        D.file_stream(spark, str(tmp_path), "gone.parquet")


# ------------------------------------------------------------------ attribution
def test_best_class_where_single_precision_is_tied(spark):
    scorer = lambda x: np.column_stack([x[:, 0], x[:, 0] + 1e-12, 1 - 2 * x[:, 0]])
    df = spark.createDataFrame([(1, [0.4]), (2, [0.1])], "row_key long, features array<double>")
    got = {r.row_key: r for r in K.score_in_batches(df, scorer, 1, pred="y_pred").collect()}
    assert got[1].y_prob[0] == got[1].y_prob[1] and (got[1].y_pred, got[2].y_pred) == (1, 2)
    assert K.score_in_batches(df, scorer, 1).columns == ["row_key", "y_prob"]


def blobs(spark, n=60, f=16, k=3, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % k
    x = rng.normal(0, 1, (n, f))
    x[:, 2] += 6 * y
    rows = [(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x))]
    return y, x, spark.createDataFrame(rows, "row_key long, y_true int, features array<double>")


def test_permutation_finds_the_feature(spark):
    y, x, df = blobs(spark)
    g = V.geometry(16)
    cent = np.array([x[y == c].mean(axis=0) for c in range(3)])
    scorer = K.subband_centroid_scorer(cent @ V.transform_matrix(g), g)
    a = I.permutation_importance(df, scorer, 16, 3, seed=1).orderBy("rank").collect()
    b = I.permutation_importance(df.repartition(5), scorer, 16, 3, seed=1).orderBy("rank").collect()
    assert a == b and a[0].feature == "f2" and a[0].mean_decrease > 0.3 and len(a) == 16
    assert all(abs(r.mean_decrease) < 0.2 for r in a[1:])


def test_permutation_moves_whole_columns(spark, tmp_path):
    """What the scorer is given: each repeat permutes one column and leaves the others."""
    _, x, df = blobs(spark, 40, 4)
    seen = tmp_path / "seen"
    seen.mkdir()

    def score(m):
        np.save(seen / f"{len(list(seen.iterdir())):03d}.npy", m)
        return np.tile([1.0, 0.0, 0.0], (len(m), 1))

    I.permutation_importance(df, score, 4, 2, seed=3).collect()
    given = [np.load(p) for p in sorted(seen.iterdir())][: 1 + 4 * 2]
    base, varied = given[0], given[1:]
    assert sorted(map(tuple, base)) == sorted(map(tuple, x))
    for at, m in enumerate(varied):
        j = at // 2
        assert sorted(m[:, j]) == sorted(x[:, j]) and (m[:, j] != base[:, j]).any()
        assert np.array_equal(np.delete(m, j, axis=1), np.delete(base, j, axis=1))
    assert not np.array_equal(varied[0], varied[1])


def test_ablation_against_brute_force(spark):
    y, x, df = blobs(spark)
    g = V.geometry(16)
    m = V.transform_matrix(g)
    cent = np.array([x[y == c].mean(axis=0) for c in range(3)]) @ m
    out = {r.branch: r for r in I.group_ablation(V.with_subbands(df, "features", g), K.centroid_scorer(cent)).collect()}

    def f1(z):
        p = ((z[:, None, :] - cent[None]) ** 2).sum(axis=2).argmin(axis=1)
        return np.mean([2 * ((y == c) & (p == c)).sum() / max(1, (y == c).sum() + (p == c).sum()) for c in range(3)])

    z = x @ m
    for i, name in enumerate(V.SUBBANDS):
        zeroed = z.copy()
        zeroed[:, 16 * i : 16 * (i + 1)] = 0
        assert out[name].macro_f1_full == pytest.approx(f1(z)) and out[name].macro_f1_ablated == pytest.approx(f1(zeroed))


def test_importance_comparison(spark):
    perm = spark.createDataFrame([(f"f{i}", 1.0 - i / 20, i + 1) for i in range(20)], "feature string, mean_decrease double, rank int")
    attr = spark.createDataFrame([(f"f{i}", 1.0 - i / 20, i + 1) for i in range(20)], "feature string, mean_abs double, rank int")
    rows = I.importance_comparison(perm, attr).collect()
    assert rows[0].top_consensus and not rows[-1].top_consensus
    some = I.importance_comparison(perm, attr.filter("rank > 5")).collect()
    assert rows[0].feature == some[0].feature and some[0].rank_attribution is None and not some[0].top_consensus


def test_fold_drops_padding(spark):
    g = V.geometry(13)
    _, x, df = blobs(spark, 20, 13)
    bands = V.with_subbands(df, "features", g)
    out = {r.feature: r for r in I.fold_attribution(bands, "subbands", 13).collect()}
    want = np.abs((x @ V.transform_matrix(g)).reshape(20, 4, 16)).sum(axis=1).mean(axis=0)[:13]
    assert len(out) == 13 and sum(r.percent for r in out.values()) == pytest.approx(100)
    assert all(out[f"f{i}"].mean_abs == pytest.approx(want[i]) for i in range(13))


def test_classifier_learns(spark):
    _, _, df = blobs(spark, 90)
    scored = K.fit_score_classifier(df, df, 3, 16)
    hit = scored.filter(F.array_position("y_prob", F.array_max("y_prob")) - 1 == F.col("y_true")).count()
    assert hit > 80

"""Queries: counter statistics, in batch and as streams."""

from pyspark.sql import functions as F

from flowloom.operators import anomaly as J
from flowloom.operators import confusion as C
from flowloom.streaming import detect as D
from flowloom.streaming import learn as L
from flowloom.streaming.ledger import run_ledger
from flowloom.workload.inputs import NORMAL_BEFORE, counters, features, logits, normal, table, with_
from flowloom.workload.registry import query, r

WIDTH_K = 0.25  # band width used here: daily counts per switch are too small for three deviations

_KEYS = "switch, strftime(window_start, '%Y-%m-%d') AS day"
_THR = f"""nrm AS (SELECT * FROM feats WHERE window_start < TIMESTAMP '{NORMAL_BEFORE}'),
 fin AS (SELECT * FROM nrm WHERE isfinite(r_pi) AND isfinite(r_fi) AND isfinite(d_np)),
 thr AS (SELECT count(*) AS n_rows, """ + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, avg({c}) {s} {WIDTH_K}::DOUBLE * stddev_pop({c}) AS {c}_threshold"
    for c, s in (("r_pi", "-"), ("r_fi", "-"), ("d_np", "+"))
) + " FROM fin)"
_PAST = "r_pi < r_pi_threshold", "r_fi < r_fi_threshold", "d_np > d_np_threshold"


def _keyed(df, *cols):
    return df.select("switch", F.date_format("window_start", "yyyy-MM-dd").alias("day"), *cols)


def _finite(c):
    return F.when(F.col(c) < float("inf"), F.round(c, 6)).alias(c)


@query("ratio_r_pi", with_("feats") + f"SELECT {_KEYS}, {r('CASE WHEN isfinite(r_pi) THEN r_pi END')} AS r_pi, NOT isfinite(r_pi) AS is_inf FROM feats")
def ratio_r_pi(spark, sf):
    c = counters(spark, sf).withColumn("r_pi", J.ratio_r_pi(F.col("n_fi"), F.col("n_packet_in_flows")))
    return _keyed(c, _finite("r_pi"), (F.col("r_pi") == float("inf")).alias("is_inf"))


@query("ratio_r_fi", with_("feats") + f"SELECT {_KEYS}, {r('CASE WHEN isfinite(r_fi) THEN r_fi END')} AS r_fi, NOT isfinite(r_fi) AS is_inf FROM feats")
def ratio_r_fi(spark, sf):
    c = counters(spark, sf).withColumn("r_fi", J.ratio_r_fi(F.col("n_fo"), F.col("n_fi")))
    return _keyed(c, _finite("r_fi"), (F.col("r_fi") == float("inf")).alias("is_inf"))


@query("delta_packets", with_("feats") + f"SELECT {_KEYS}, {r('d_np')} AS d_np FROM feats")
def delta_packets(spark, sf):
    c = counters(spark, sf).withColumn("d_np", J.delta_packets(F.col("n_packets_in"), F.col("n_packets_out")))
    return _keyed(c, F.round("d_np", 6).alias("d_np"))


_FEATS = ", ".join(f"{r(f'CASE WHEN isfinite({c}) THEN {c} END')} AS {c}" for c in ("r_pi", "r_fi", "d_np"))


@query("counter_features", with_("feats") + f"SELECT {_KEYS}, {_FEATS} FROM feats")
def counter_features(spark, sf):
    return _keyed(features(spark, sf), _finite("r_pi"), _finite("r_fi"), _finite("d_np"))


def thresholds(spark, sf):
    return J.fit_thresholds(normal(features(spark, sf)), WIDTH_K)


@query("sigma_thresholds", with_("feats", more=_THR) + "SELECT n_rows, " + ", ".join(
    f"{r(f'{c}_{s}')} AS {c}_{s}" for c in ("r_pi", "r_fi", "d_np") for s in ("mean", "std", "threshold")) + " FROM thr")
def sigma_thresholds(spark, sf):
    t = J.sigma_thresholds(normal(features(spark, sf)), WIDTH_K)
    return t.select(*[F.col(c) if c == "n_rows" else F.round(c, 6).alias(c) for c in t.columns])


@query("sigma_detect", with_("feats", more=_THR) + f"SELECT {_KEYS}, {' AND '.join(_PAST)} AS suspicious FROM feats, thr")
def sigma_detect(spark, sf):
    return _keyed(J.sigma_detect(features(spark, sf), thresholds(spark, sf)), "suspicious")


@query("sigma_explain", with_("feats", more=_THR) + "SELECT " + ", ".join(
    f"{r(f'avg(({e})::INT)')} AS {n}" for e, n in zip((*_PAST, " AND ".join(_PAST)), ("r_pi_below", "r_fi_below", "d_np_above", "all_three"))
) + " FROM feats, thr")
def sigma_explain(spark, sf):
    e = J.sigma_explain(features(spark, sf), thresholds(spark, sf))
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns])


_COUNTS = f"n_fi, n_fo, n_packet_in_flows, {r('n_packets_in')} AS n_packets_in, {r('n_packets_out')} AS n_packets_out"


def _counts(df):
    return _keyed(df, "n_fi", "n_fo", "n_packet_in_flows", F.round("n_packets_in", 6).alias("n_packets_in"), F.round("n_packets_out", 6).alias("n_packets_out"))


@query("windowed_counters", with_("counters") + f"SELECT {_KEYS}, {_COUNTS} FROM counters")
def windowed_counters(spark, sf):
    return _counts(counters(spark, sf))


@query("sliding_counters", f"""WITH twice AS (SELECT * REPLACE (date_trunc('day', ts) AS ts) FROM events UNION ALL SELECT * REPLACE (date_trunc('day', ts) - INTERVAL 1 DAY AS ts) FROM events),
 c AS (SELECT user_id AS switch, ts AS window_start, count(*) FILTER (event_type = 'view') AS n_fi, count(*) FILTER (event_type = 'click') AS n_fo,
 count(*) FILTER (event_type = 'error') AS n_packet_in_flows, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS n_packets_in,
 coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS n_packets_out FROM twice GROUP BY 1, 2) SELECT {_KEYS}, {_COUNTS} FROM c""")
def sliding_counters(spark, sf):
    c = J.windowed_counters(table(spark, sf, "events"), "user_id", "ts", "event_type", "value", "2 days", "1 day")
    return _counts(c)


# ------------------------------------------------------------------ streams
@query("stream_detect", with_("feats", more=_THR) + f"""SELECT {_KEYS}, {_FEATS}, {' AND '.join(_PAST)} AS suspicious FROM feats, thr
 WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_detect(spark, sf):
    th = thresholds(spark, sf)
    events = D.file_stream(spark, sf, "events.parquet")
    stream = D.stream_detect(events, th, "user_id", "ts", "event_type", "value")
    closed = D.run_to_table(stream, "stream-detect")
    return _keyed(closed, _finite("r_pi"), _finite("r_fi"), _finite("d_np"), "suspicious")


@query("stream_confusion", with_("pc") + f"SELECT {r('sum(tp)::DOUBLE / sum(support)')} AS accuracy, {r('avg(f1) FILTER (support > 0)')} AS macro_f1, sum(support)::BIGINT AS n_samples FROM pc")
def stream_confusion(spark, sf):
    from flowloom.functions.vectors import softmax

    vec = D.file_stream(spark, sf, "embeddings.parquet")
    p = vec.select(
        F.col("label").alias("y_true"),
        F.transform(softmax(logits("embedding")), lambda x: x.cast("float")).alias("y_prob"),
    )
    snapshot = D.run_complete(D.stream_confusion(C.with_prediction(p)))
    s = C.class_summary(C.per_class(snapshot))
    return s.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "n_samples")


@query("stream_sigma_thresholds", with_("feats", more=_THR) + "SELECT n_rows, " + ", ".join(f"{r(f'{c}_threshold')} AS {c}_threshold" for c in ("r_pi", "r_fi", "d_np")) + " FROM thr")
def stream_sigma_thresholds(spark, sf):
    """Learned batch by batch inside the stream, equal to one pass over all rows."""
    events = D.file_stream(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    closed = J.counter_features(J.windowed_counters(events, "user_id", "ts", "event_type", "value"))
    states, _ = L.learn_and_detect(closed, F.col("window_start") < F.lit(NORMAL_BEFORE).cast("timestamp"), k=WIDTH_K)
    th = L.thresholds_of(states.latest(), WIDTH_K)
    row = (th.n_rows, *(round(x, 6) + 0.0 for x in (th.r_pi, th.r_fi, th.d_np)))
    return spark.createDataFrame([row], "n_rows long, r_pi_threshold double, r_fi_threshold double, d_np_threshold double")


def _ledger(spark, sf):
    ts = F.col("ts").cast("timestamp")
    epoch = (F.datediff(ts, F.lit("2024-01-01").cast("date")) + 1).alias("epoch")
    return run_ledger(D.file_stream(spark, sf, "events.parquet").select(epoch, "event_id"), "epoch", "event_id")


_EPOCH = "(ts::DATE - DATE '2024-01-01' + 1)::INT AS epoch"


@query("stream_append_unique", f"SELECT DISTINCT {_EPOCH} FROM events")
def stream_append_unique(spark, sf):
    return _ledger(spark, sf).where("accepted").select("epoch")


@query("stream_repeats", f"SELECT {_EPOCH}, count(*) - 1 AS n_repeats FROM events GROUP BY 1 HAVING count(*) > 1")
def stream_repeats(spark, sf):
    """The side output: rows whose epoch was there before."""
    return _ledger(spark, sf).where("NOT accepted").groupBy("epoch").agg(F.count(F.lit(1)).alias("n_repeats"))

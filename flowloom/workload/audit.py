"""Queries: history, reconciliation and quality checks."""

from pyspark.sql import functions as F

from flowloom.operators import audit as A
from flowloom.operators.sampling import split_class_counts
from flowloom.sources.parquet import rows_by_dataset, rows_by_file
from flowloom.workload.inputs import flow_split, flows, history, preds, table, with_
from flowloom.workload.registry import query, r

TOTAL_EPOCHS = 100


@query("append_unique", with_("history") + "SELECT epoch, count(*) AS n_new, true AS already_known FROM history WHERE epoch BETWEEN 18 AND 20 GROUP BY 1")
def append_unique(spark, sf):
    h = history(spark, sf)
    return A.append_violations(h.filter(F.col("epoch") <= 20), h.filter(F.col("epoch") >= 18))


@query("append_history", with_("history") + f"SELECT epoch, session_id, {r('epoch_seconds')} AS epoch_seconds FROM history")
def append_history(spark, sf):
    h = history(spark, sf).select("epoch", "session_id", F.round("epoch_seconds", 6).alias("epoch_seconds"))
    return A.append_unique(h.filter(F.col("epoch") <= 20), h.filter(F.col("epoch") > 20))


_GAPPED = """g AS (SELECT epoch FROM history WHERE epoch NOT IN (5, 9) UNION ALL SELECT epoch FROM history WHERE epoch = 3)"""


@query("sequence_gaps", with_("history", more=_GAPPED) + """SELECT e::BIGINT AS epoch, 'missing' AS problem FROM range(1, (SELECT count(*) + 1 FROM g)) t(e)
 WHERE e NOT IN (SELECT epoch FROM g) UNION ALL SELECT epoch::BIGINT, 'repeated' FROM g GROUP BY epoch HAVING count(*) > 1""")
def sequence_gaps(spark, sf):
    h = history(spark, sf).select("epoch")
    return A.sequence_gaps(h.filter(~F.col("epoch").isin(5, 9)).unionByName(h.filter(F.col("epoch") == 3)))


@query("session_boundaries", with_("history") + """SELECT epoch, session_id, previous FROM
 (SELECT epoch, session_id, lag(session_id) OVER (ORDER BY epoch) AS previous FROM history) WHERE previous IS NOT NULL AND previous <> session_id""")
def session_boundaries(spark, sf):
    return A.session_boundaries(history(spark, sf))


@query("history_rollup", with_("history") + f"""SELECT count(DISTINCT session_id) AS n_sessions, {r('sum(epoch_seconds)', 2)} AS total_seconds,
 {r('max(peak_rss_mb)')} AS peak_rss_mb, max(epoch) AS last_epoch FROM history""")
def history_rollup(spark, sf):
    return A.history_rollup(history(spark, sf)).withColumn("peak_rss_mb", F.round("peak_rss_mb", 6))


@query("remaining_estimate", with_("history") + f"""SELECT {r('avg(epoch_seconds)')} AS mean_epoch_seconds, {TOTAL_EPOCHS} - max(epoch) AS epochs_left,
 {r(f'avg(epoch_seconds) * ({TOTAL_EPOCHS} - max(epoch))', 4)} AS seconds_left FROM history""")
def remaining_estimate(spark, sf):
    out = A.remaining_estimate(history(spark, sf), TOTAL_EPOCHS)
    return out.withColumns({"mean_epoch_seconds": F.round("mean_epoch_seconds", 6), "seconds_left": F.round("seconds_left", 4)})


@query("stall_detect", with_("history") + """SELECT epoch, progress, coalesce(count(*) OVER w = 3 AND min(progress) OVER w = max(progress) OVER w, false) AS stalled
 FROM history WINDOW w AS (ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def stall_detect(spark, sf):
    return A.stall_detect(history(spark, sf), "epoch", "progress")


@query("partial_epochs", with_("history") + "SELECT epoch, resumed_after, coalesce(resumed_after, 0) > 0 AS ok FROM history WHERE is_partial")
def partial_epochs(spark, sf):
    return A.partial_epochs(history(spark, sf), "is_partial", "resumed_after")


@query("count_reconcile", with_("split", more="""c AS (SELECT (SELECT count(*) FROM orders) AS n_files,
 (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM flows GROUP BY label)) AS n_classes, (SELECT count(*) FROM split WHERE split IN ('train', 'val', 'test')) AS n_splits)""")
       + "SELECT *, n_files = n_classes AND n_files = n_splits AS ok FROM c")
def count_reconcile(spark, sf):
    files = rows_by_file(table(spark, sf, "orders")).withColumnRenamed("n_rows", "n")
    classes = flows(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    per = split_class_counts(flow_split(spark, sf), "label")
    splits = per.select((F.col("train") + F.col("val") + F.col("test")).alias("n"))
    return A.count_reconcile(files, classes, splits)


REQUIRED = ("view", "click", "error", "purchase", "refund", "signup")


@query("metric_set_complete", f"""SELECT m AS metric FROM (SELECT unnest({list(REQUIRED)}) AS m) WHERE m NOT IN
 (SELECT event_type FROM events WHERE event_type <> 'signup' GROUP BY 1 HAVING avg(value) IS NOT NULL)""")
def metric_set_complete(spark, sf):
    kind = F.col("event_type")
    metrics = table(spark, sf, "events").groupBy(kind.alias("metric")).agg(
        F.avg(F.when(kind != "signup", F.col("value"))).alias("value")
    )
    return A.missing_metrics(metrics, REQUIRED)


@query("prediction_diff", with_("preds", more="""q AS (SELECT row_key, list_transform(y_prob, lambda v, i: CASE WHEN i = 1 AND row_key % 7 = 0 THEN (v::DOUBLE + 1e-6::DOUBLE)::FLOAT ELSE v END) AS y_prob FROM preds WHERE row_key <> 3),
 d AS (SELECT p.row_key AS a, q.row_key AS b, list_max(list_transform(range(1, 11), lambda i: abs(p.y_prob[i]::DOUBLE - q.y_prob[i]::DOUBLE))) AS m, len(p.y_prob) <> len(q.y_prob) AS other FROM preds p FULL OUTER JOIN q ON p.row_key = q.row_key)""")
       + f"""SELECT count(*) AS n_rows, count(*) FILTER (a IS NULL OR b IS NULL) AS n_one_sided, count(*) FILTER (other) AS n_shape_differs,
 {r('max(m) FILTER (a IS NOT NULL AND b IS NOT NULL)', 7)} AS max_diff,
 count(*) FILTER (a IS NULL OR b IS NULL OR other) = 0 AND max(m) FILTER (a IS NOT NULL AND b IS NOT NULL) <= 1e-5 AS ok FROM d""")
def prediction_diff(spark, sf):
    p = preds(spark, sf)
    moved = F.transform(
        "y_prob",
        lambda v, i: F.when((i == 0) & (F.col("row_key") % 7 == 0), (v.cast("double") + 1e-6).cast("float")).otherwise(v),
    )
    q = p.filter(F.col("row_key") != 3).withColumn("y_prob", moved)
    return A.prediction_diff(p, q).withColumn("max_diff", F.round("max_diff", 7))


@query("expected_values", """SELECT a.event_type AS "key", a.n AS expected, b.n AS actual FROM
 (SELECT event_type, count(*)::VARCHAR AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1) a LEFT JOIN
 (SELECT event_type, count(*)::VARCHAR AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> 'signup' GROUP BY 1) b USING (event_type)
 WHERE a.n IS DISTINCT FROM b.n""")
def expected_values(spark, sf):
    events = table(spark, sf, "events")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")

    def counts(df):
        return df.groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))

    early = counts(events.filter(F.col("ts") < middle))
    late = counts(events.filter((F.col("ts") >= middle) & (F.col("event_type") != "signup")))
    return A.expected_mismatches(late, early)


def checks(spark, sf):
    h, p = history(spark, sf), preds(spark, sf)
    total = F.aggregate("y_prob", F.lit(0.0), lambda a, x: a + x.cast("double"))
    late = h.filter(F.col("epoch") > 1000)
    return [
        A.check_row(h, "history_continuous", F.max("epoch") != F.count(F.lit(1)), F.count(F.lit(1)) == 0),
        A.check_row(p, "probabilities_sum_to_one", F.max(F.abs(total - 1)) > 1e-5),
        A.check_row(h, "peak_memory", F.max("peak_rss_mb") > 28_000, F.count("peak_rss_mb") == 0),
        A.check_row(h, "partial_resume", F.count_if(F.col("is_partial") & F.col("resumed_after").isNull()) > 0),
        A.check_row(late, "late_progress", F.min("progress") == F.max("progress"), F.count(F.lit(1)) < 3),
    ]


_CHECKS = """checks AS (
 SELECT 'history_continuous' AS check_name, CASE WHEN max(epoch) <> count(*) THEN 'FAIL' ELSE 'PASS' END AS status FROM history
 UNION ALL SELECT 'probabilities_sum_to_one', CASE WHEN max(abs(list_sum(list_transform(y_prob, lambda v: v::DOUBLE)) - 1)) > 1e-5 THEN 'FAIL' ELSE 'PASS' END FROM preds
 UNION ALL SELECT 'peak_memory', CASE WHEN max(peak_rss_mb) > 28000 THEN 'FAIL' ELSE 'PASS' END FROM history
 UNION ALL SELECT 'partial_resume', CASE WHEN count(*) FILTER (is_partial AND resumed_after IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END FROM history
 UNION ALL SELECT 'late_progress', CASE WHEN count(*) < 3 THEN 'SKIP' WHEN min(progress) = max(progress) THEN 'FAIL' ELSE 'PASS' END FROM history WHERE epoch > 1000)"""


@query("quality_report", with_("history", "preds", more=_CHECKS) + """SELECT check_name, status, 1::BIGINT AS n FROM checks
 UNION ALL SELECT NULL, status, count(*) FROM checks GROUP BY status""")
def quality_report(spark, sf):
    return A.quality_report(checks(spark, sf))


@query("resource_ceiling", with_("history") + f"SELECT {r('max(peak_rss_mb)')} AS peak_mb, CASE WHEN max(peak_rss_mb) > 1000 THEN 'FAIL' ELSE 'PASS' END AS status FROM history")
def resource_ceiling(spark, sf):
    return A.resource_ceiling(history(spark, sf), 1000.0).withColumn("peak_mb", F.round("peak_mb", 6))


_STAGES = {"t_scale": "l_tax * 10", "t_swt": "l_discount * 10", "t_forward": "l_quantity"}
_TOTAL_SQL = "round((l_tax * 10 + l_discount * 10 + l_quantity)::DOUBLE, 4)"


@query("latency_percentiles", "SELECT l_linenumber AS batch_size, " + ", ".join(
    f"{r(f'quantile_cont({e}, {q})')} AS {s}_{n}" for s, e in {**_STAGES, "t_total": _TOTAL_SQL}.items() for q, n in ((0.5, "p50"), (0.95, "p95"))
) + f""", {r(f'l_linenumber * 1000.0::DOUBLE / quantile_cont({_TOTAL_SQL}, 0.5)')} AS rows_per_second,
 {r(f'100 * quantile_cont(l_discount * 10, 0.5) / quantile_cont({_TOTAL_SQL}, 0.5)')} AS share_percent FROM lineitem GROUP BY 1""")
def latency_percentiles(spark, sf):
    samples = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("batch_size"),
        (F.col("l_tax") * 10).alias("t_scale"), (F.col("l_discount") * 10).alias("t_swt"), F.col("l_quantity").alias("t_forward"),
        F.round(F.col("l_tax") * 10 + F.col("l_discount") * 10 + F.col("l_quantity"), 4).alias("measured"),
    )
    out = A.latency_percentiles(samples, "batch_size", ["t_scale", "t_swt", "t_forward"], "t_swt", "measured")
    return out.select("batch_size", *[F.round(c, 6).alias(c) for c in out.columns if c != "batch_size"])


_REQUIRED = ("orders", "lineitem", "labels")


@query("artifact_presence", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) > 0 AS present, count(*) AS n_rows FROM {t}" for t in _REQUIRED)
       + " UNION ALL SELECT 'y_true.parquet', false, 0")
def artifact_presence(spark, sf):
    """Required inputs as the scan finds them: their rows are counted, a table that is not there has none."""
    return A.artifact_presence(rows_by_dataset(spark, sf), [f"{t}.parquet" for t in (*_REQUIRED, "y_true")])

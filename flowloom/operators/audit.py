"""History checks, reconciliation and data-quality reports.

History tables hold one row per epoch, so windows over them in epoch order are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.bounds import bounded

MAX_EPOCHS = 1_000_000


def _ordered(history: DataFrame, epoch: str) -> DataFrame:
    return bounded(history, MAX_EPOCHS, "history")


# ------------------------------------------------------------------ history
def append_violations(history: DataFrame, new_rows: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Epochs of ``new_rows`` that the history already has or that come twice."""
    known = history.select(F.col(epoch)).distinct().withColumn("_known", F.lit(True))
    new = new_rows.groupBy(epoch).agg(F.count(F.lit(1)).alias("n_new"))
    return (
        new.join(known, epoch, "left")
        .select(epoch, "n_new", F.coalesce("_known", F.lit(False)).alias("already_known"))
        .filter(F.col("already_known") | (F.col("n_new") > 1))
    )


def append_unique(history: DataFrame, new_rows: DataFrame, epoch: str = "epoch") -> DataFrame:
    """History plus new rows. An epoch that occurs already, or twice, is an error."""
    bad = append_violations(history, new_rows, epoch).limit(5).collect()  # examples for the message
    if bad:
        raise ValueError(f"epochs already in the history: {sorted(r[epoch] for r in bad)}")
    return history.unionByName(new_rows)


def sequence_gaps(history: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Keys missing from 1..n and keys that repeat, n being the number of rows: (epoch, problem)."""
    counts = history.groupBy(F.col(epoch).cast("long").alias("epoch")).agg(F.count(F.lit(1)).alias("_c"))
    wanted = history.sparkSession.range(1, history.count() + 1).select(F.col("id").alias("epoch"))
    missing = wanted.join(counts, "epoch", "left_anti").select("epoch", F.lit("missing").alias("problem"))
    repeated = counts.filter(F.col("_c") > 1).select("epoch", F.lit("repeated").alias("problem"))
    return missing.unionByName(repeated)


def session_boundaries(history: DataFrame, epoch: str = "epoch", session: str = "session_id") -> DataFrame:
    """Epochs whose session differs from that of the previous row."""
    prev = F.lag(session).over(Window.orderBy(epoch))
    return (
        _ordered(history, epoch)
        .select(epoch, session, prev.alias("previous"), F.row_number().over(Window.orderBy(epoch)).alias("_i"))
        .filter((F.col("_i") > 1) & ~F.col(session).eqNullSafe(F.col("previous")))
        .drop("_i")
    )


def history_rollup(history: DataFrame) -> DataFrame:
    """Sessions, total seconds, peak memory and last epoch: one row."""
    return history.agg(
        F.count_distinct("session_id").alias("n_sessions"),
        F.round(F.coalesce(F.sum("epoch_seconds"), F.lit(0.0)), 2).alias("total_seconds"),
        F.coalesce(F.max("peak_rss_mb"), F.lit(0.0)).alias("peak_rss_mb"),
        F.coalesce(F.max("epoch"), F.lit(0)).alias("last_epoch"),
    )


def remaining_estimate(history: DataFrame, total_epochs: int) -> DataFrame:
    """Epochs left and the time they take at the mean pace so far."""
    left = F.greatest(F.lit(total_epochs) - F.coalesce(F.max("epoch"), F.lit(0)), F.lit(0))
    pace = F.avg("epoch_seconds")
    return history.agg(
        pace.alias("mean_epoch_seconds"), left.alias("epochs_left"), (pace * left).alias("seconds_left")
    )


def stall_detect(log: DataFrame, order: str, progress: str, width: int = 3) -> DataFrame:
    """Rows at which the last ``width`` values of progress are equal."""
    frame = Window.orderBy(order).rowsBetween(1 - width, 0)
    full = F.count(F.lit(1)).over(frame) == width
    flat = F.min(progress).over(frame) == F.max(progress).over(frame)
    return bounded(log, MAX_EPOCHS, "progress log").select(
        order, progress, F.coalesce(full & flat, F.lit(False)).alias("stalled")
    )


def partial_epochs(history: DataFrame, flag: str, offset: str, epoch: str = "epoch") -> DataFrame:
    """Interrupted epochs, and whether they say from which batch they went on."""
    return history.filter(F.col(flag)).select(
        epoch, F.col(offset).alias("resumed_after"), (F.coalesce(F.col(offset), F.lit(0)) > 0).alias("ok")
    )


# ------------------------------------------------------------------ reconciliation
def count_reconcile(files: DataFrame, classes: DataFrame, splits: DataFrame) -> DataFrame:
    """Totals of three count tables (column n) side by side: one row."""
    part = lambda df, name: df.agg(F.sum("n").alias("n")).select(F.lit(name).alias("src"), "n")
    all_parts = part(files, "files").unionByName(part(classes, "classes")).unionByName(part(splits, "splits"))
    pick = lambda s: F.max(F.when(F.col("src") == s, F.col("n")))
    return all_parts.agg(
        pick("files").alias("n_files"),
        pick("classes").alias("n_classes"),
        pick("splits").alias("n_splits"),
        (F.min("n") == F.max("n")).alias("ok"),
    )


def missing_metrics(metrics: DataFrame, required: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Required names that are absent or have no value."""
    want = metrics.sparkSession.createDataFrame([(r,) for r in required], "metric string")
    have = metrics.filter(F.col(value).isNotNull()).select(F.col(name).alias("metric"))
    return want.join(have, "metric", "left_anti")


def prediction_diff(a: DataFrame, b: DataFrame, key: str = "row_key", tolerance: float = 1e-5) -> DataFrame:
    """Largest probability difference of two prediction tables and rows found in one only."""
    left = a.select(key, F.col("y_prob").alias("_p"))
    right = b.select(key, F.col("y_prob").alias("_q"))
    diff = F.array_max(
        F.zip_with("_p", "_q", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    )
    joined = left.join(right, key, "full_outer")
    one_sided = F.col("_p").isNull() | F.col("_q").isNull()
    shape = ~one_sided & (F.size("_p") != F.size("_q"))
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(one_sided).alias("n_one_sided"),
        F.count_if(shape).alias("n_shape_differs"),
        F.max(F.when(~one_sided & ~shape, diff)).alias("max_diff"),
    ).withColumn(
        "ok",
        (F.col("n_one_sided") == 0) & (F.col("n_shape_differs") == 0)
        & F.coalesce(F.col("max_diff") <= tolerance, F.lit(True)),
    )


def expected_mismatches(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys whose value is not the expected one: (key, expected, actual)."""
    return (
        expected.select("key", F.col("value").alias("expected"))
        .join(actual.select("key", F.col("value").alias("actual")), "key", "left")
        .filter(~F.col("expected").eqNullSafe(F.col("actual")))
    )


def resource_ceiling(history: DataFrame, limit_mb: float, column: str = "peak_rss_mb") -> DataFrame:
    peak = F.max(column)
    return history.agg(
        peak.alias("peak_mb"),
        F.when(F.coalesce(peak, F.lit(0.0)) <= 0, "SKIP").when(peak > limit_mb, "FAIL").otherwise("PASS").alias("status"),
    )


def artifact_presence(listing: DataFrame, required: Sequence[str], name: str = "file") -> DataFrame:
    """Required files with a flag whether the listing has them, and their rows where it counts them (``n_rows``)."""
    want = listing.sparkSession.createDataFrame([(r,) for r in required], "file string")
    rows = [F.sum("n_rows").alias("n_rows")] if "n_rows" in listing.columns else []
    have = listing.groupBy(F.col(name).alias("file")).agg(F.first(F.lit(True)).alias("_h"), *rows)
    out = [F.coalesce("n_rows", F.lit(0)).alias("n_rows")] if rows else []
    return want.join(have, "file", "left").select("file", F.coalesce("_h", F.lit(False)).alias("present"), *out)


# ------------------------------------------------------------------ reports
def check_row(df: DataFrame, name: str, failed: Column, skipped: Column | None = None) -> DataFrame:
    """One check from aggregates over ``df``: FAIL, PASS, or SKIP when there is nothing to judge."""
    skip = skipped if skipped is not None else F.lit(False)
    return df.agg(
        F.lit(name).alias("check_name"),
        F.when(skip, "SKIP").when(F.coalesce(failed, F.lit(False)), "FAIL").otherwise("PASS").alias("status"),
    )


def quality_report(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks with a total per status (check_name NULL)."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    totals = out.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast("string").alias("check_name"), "status", "n"
    )
    return out.withColumn("n", F.lit(1).cast("long")).unionByName(totals)


#: Cells of an octave of values; where each half of the axis begins.
CELLS_PER_OCTAVE, CELL_ORIGIN = 64, 200_000


def value_cell(v: Column) -> Column:
    """Number of a cell of the value axis, growing with the value; at most some 280,000 cells in all."""
    size = F.floor(F.log2(F.abs(v)) * CELLS_PER_OCTAVE) + CELL_ORIGIN
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def exact_percentiles(values: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(*keys, share, result): interpolated percentiles of the values of each group.

    Values meet in counts. Totals of the cells say in which cell a rank falls, and only the distinct
    values of that cell are ordered, so no group is ever held in one buffer.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_cell", value_cell(F.col("_v")))
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_c"))
    whole = Window.partitionBy(*keys)
    upto = cells.select(
        *keys, "_cell", "_c", F.sum("_c").over(whole.orderBy("_cell")).alias("_upto"), F.sum("_c").over(whole).alias("_all"),
    )
    position = F.col("_share") * (F.col("_all") - 1)
    wanted = upto.withColumn("_share", F.explode(F.array(*[F.lit(float(x)) for x in shares]))).withColumn("_pos", position)
    wanted = wanted.withColumn("_rank", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))))
    edges = wanted.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))).select(
        *[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_ecell"), "_share", "_pos", "_rank",
        (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_at"),
    ).distinct()
    inside = [*keys, "_cell"]
    running = counts.withColumn("_to", F.sum("_n").over(Window.partitionBy(*inside).orderBy("_v")))
    same = [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(keys)] + [F.col("_cell") == F.col("_ecell")]
    found = running.join(edges, same).where((F.col("_at") < F.col("_to")) & (F.col("_at") >= F.col("_to") - F.col("_n")))
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    return found.groupBy(*keys, F.col("_share").alias("share")).agg(
        (low + (high - low) * (F.first("_pos") - F.min("_rank"))).alias("result")
    )


def latency_percentiles(
    samples: DataFrame, batch: str, stages: Sequence[str], share_of: str, total: str | None = None
) -> DataFrame:
    """p50 and p95 of every stage and of their sum per batch size, throughput, share of one stage."""
    total_col = F.col(total) if total else sum((F.col(s) for s in stages[1:]), F.col(stages[0]))
    df = samples.withColumn("t_total", total_col)
    names = [*stages, "t_total"]
    long = df.select(batch, F.inline(F.array(*[F.struct(F.lit(n).alias("_stage"), F.col(n).cast("double").alias("_value")) for n in names])))
    points = exact_percentiles(long, [batch, "_stage"], "_value", [0.5, 0.95])
    pick = lambda n, x: F.max(F.when((F.col("_stage") == n) & (F.col("share") == x), F.col("result")))
    out = points.groupBy(batch).agg(*[pick(n, x).alias(f"{n}_{p}") for n in names for p, x in (("p50", 0.5), ("p95", 0.95))])
    half = F.col("t_total_p50")
    return out.select(
        "*",
        F.when(half > 0, F.col(batch) * 1000.0 / half).alias("rows_per_second"),
        F.when(half > 0, 100 * F.col(f"{share_of}_p50") / half).alias("share_percent"),
    )

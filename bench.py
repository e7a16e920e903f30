"""Timings of the headline queries, one JSON line on standard output.

Each query is run twice and the second run counts; results go to a sink that discards them, so
no row is carried through the driver. The throughput figures repeat the given rows inside Spark
until fixed costs no longer dominate.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from flowloom.functions import wavelet as V
from flowloom.operators import scoring as K
from flowloom.operators import stats as E
from flowloom.session import build_session
from flowloom.workload import QUERIES, inputs
from flowloom.workload.attribution import raw_centroids

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))

HEADLINE = [
    "scan_flows", "label_profile", "encode_labels", "stratified_split", "group_split", "subsample_capped",
    "epoch_batches", "split_leakage", "column_stats", "column_drop_report", "minmax_scale", "prepare_dataset",
    "feature_table_sink", "swt_subbands", "swt_transform", "subband_energy", "energy_by_class",
    "confusion_matrix", "per_class_prf", "binary_view", "log_loss", "ovr_roc_auc", "roc_curve", "pr_curve",
    "macro_roc", "summary_metrics", "prediction_diff", "history_rollup", "latency_percentiles",
    "windowed_counters", "sigma_detect", "stream_detect", "centroid_scorer", "group_ablation",
    "fold_attribution", "permutation_importance",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


def repeated(df, times: int):
    """Every row ``times`` times, with keys that stay unique, spread over all cores."""
    copies = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return copies.withColumn("row_key", F.col("row_key") * times + F.col("_i")).drop("_i").repartition(4 * int(CPUS))


WIDE_ROWS, WIDE_COLUMNS = 1_000_000, 81


def wide(spark) -> dict[str, float]:
    """Preparation and scaling of a table of 81 features, written to Parquet and scanned from it.

    Every feature is a multiple of one of the given ones, so that no two are equal. Scaling is given net of a
    bare scan of the same table.
    """
    from flowloom.plans.prepare import prepare_dataset

    base = inputs.flows(spark, SF_DIR)
    rows = repeated(base, -(-WIDE_ROWS // base.count()))
    names = [f"w{i}" for i in range(WIDE_COLUMNS)]
    real = [c for c in inputs.FEATURES if c != "f_const"]
    made = [(F.col(real[i % len(real)]) * (1.0 + i) + (F.col("row_key") % (i + 2))).alias(c) for i, c in enumerate(names)]
    path = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/wide"
    rows.select("row_key", "label", *made).write.parquet(path)
    table = spark.read.parquet(path)
    n = table.count()
    scaler = E.Scaler.collect(E.scaler_stats(E.column_stats(table, names, split=None)))
    steps = {
        "scan": lambda: drain(table), "stats": lambda: E.column_stats(table, names, split=None).collect(),
        "scale": lambda: drain(E.minmax_scale(table, scaler)),
        "prepare": lambda: drain(prepare_dataset(table, "row_key", "label", names, merge=inputs.MERGE).scaled),
    }
    took = {}
    for name, step in steps.items():
        step()
        took[name] = timed(step)
    out = {f"wide_{k}_rows_per_sec": n / v for k, v in took.items()}
    out["wide_scale_net_rows_per_sec"] = n / max(1e-9, took["scale"] - took["scan"])
    return {"wide_rows": n, "wide_columns": WIDE_COLUMNS, **{k: round(v) for k, v in out.items()}}


def throughput(spark) -> dict[str, float]:
    out = {}
    vec = repeated(inputs.vectors(spark, SF_DIR), 400).persist()
    n = vec.count()
    geom = inputs.GEOM
    drain(V.with_subbands(vec, "features", geom))
    out["wavelet_rows_per_sec"] = n / timed(lambda: drain(V.with_subbands(vec, "features", geom)))
    cent = raw_centroids(spark, SF_DIR) @ V.transform_matrix(geom)
    scorer = K.subband_centroid_scorer(cent, geom)
    drain(K.score_in_batches(vec, scorer, inputs.WIDTH))
    out["wavelet_and_score_rows_per_sec"] = n / timed(lambda: drain(K.score_in_batches(vec, scorer, inputs.WIDTH)))
    vec.unpersist()
    flows = repeated(inputs.flows(spark, SF_DIR), 20).persist()
    n = flows.count()
    scaler = E.Scaler.collect(E.scaler_stats(E.column_stats(flows, inputs.FEATURES, split=None)))
    out["scale_rows_per_sec"] = n / timed(lambda: drain(E.minmax_scale(flows, scaler)))
    from flowloom.plans.prepare import prepare_dataset

    def build() -> None:
        drain(prepare_dataset(flows, "row_key", "label", inputs.FEATURES, merge=inputs.MERGE).scaled)

    build()
    out["prepare_rows_per_sec"] = n / timed(build)
    flows.unpersist()
    return {k: round(v) for k, v in out.items()}


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names if names != ["wide"] else []:
        run = lambda: drain(QUERIES[name](spark, SF_DIR))  # noqa: B023, E731
        run()
        times[name] = round(timed(run), 3)
    extra = {} if sys.argv[1:] else {"throughput": throughput(spark) | wide(spark)}
    if names == ["wide"]:
        extra, times = {"throughput": wide(spark)}, {}
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), **extra,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

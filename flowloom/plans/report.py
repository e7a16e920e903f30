"""Report tables: the data behind each figure, as DataFrames in report format."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.wavelet import SUBBANDS, energy_share
from flowloom.operators import confusion as C
from flowloom.operators import curves as R
from flowloom.operators.bounds import bounded
from flowloom.operators.audit import MAX_EPOCHS
from flowloom.operators.sampling import split_class_counts
from flowloom.plans.evaluate import per_class_report
from flowloom.sources.sinks import report_format

MACRO = -2  # class code of the averaged ROC curve


def learning_curves(history: DataFrame) -> DataFrame:
    return report_format(history)


def lr_schedule(history: DataFrame) -> DataFrame:
    return history.select("epoch", "learning_rate")


def confusion_tables(preds: DataFrame, num_classes: int) -> DataFrame:
    """Counts and row shares, wide: pred_0.. and share_0.. per true class."""
    cm = C.confusion_matrix(C.with_prediction(preds), num_classes)
    counts = C.confusion_wide(cm, num_classes)
    shares = C.confusion_wide(C.row_normalised(cm), num_classes, "share")
    for c in range(num_classes):
        shares = shares.withColumnRenamed(f"pred_{c}", f"share_{c}")
    return report_format(counts.join(shares, "y_true"))


def roc_table(preds: DataFrame, max_points: int | None = None) -> DataFrame:
    """Class, micro (-1) and macro (-2) ROC points; thinned only where ``max_points`` asks for it."""
    points = R.roc_points(preds, micro=True, max_points=max_points)
    macro = R.macro_roc(preds).select(
        F.lit(MACRO).alias("class"), F.col("idx").cast("long").alias("idx"), "fpr", "tpr", F.lit(0.0).alias("threshold")
    )
    return report_format(points.unionByName(macro))


def pr_table(preds: DataFrame, max_points: int | None = None) -> DataFrame:
    return report_format(R.pr_points(preds, micro=True, max_points=max_points))


def per_class_table(preds: DataFrame, num_classes: int) -> DataFrame:
    """Per-class metrics, rarest class first."""
    return report_format(per_class_report(preds, num_classes)).orderBy("support", "class")


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    return split_class_counts(rows, label)


def epoch_time(history: DataFrame) -> DataFrame:
    """Seconds and pace per epoch with the session's number in order of first appearance."""
    first = F.min("epoch").over(Window.partitionBy("session_id"))
    numbered = bounded(history, MAX_EPOCHS, "history").withColumn("_first", first)
    return report_format(
        numbered.select(
            "epoch", "session_id", "epoch_seconds", "samples_per_second",
            F.dense_rank().over(Window.orderBy("_first")).alias("session_ordinal"),
        )
    )


def subband_energy_table(energy: DataFrame, label: str) -> DataFrame:
    return report_format(energy_share(energy).select(label, *SUBBANDS))


def baseline_table(preds: DataFrame, num_classes: int, benign_code: int = 0) -> DataFrame:
    cm = C.confusion_matrix(C.with_prediction(preds), num_classes)
    return C.baseline_comparison(C.binary_view(cm, benign_code))


def report_all(inputs: Mapping[str, DataFrame | None], num_classes: int, label: str = "class") -> dict[str, DataFrame]:
    """Every table whose inputs are there. Nothing is computed until a table is read."""
    have: Callable[[str], DataFrame | None] = inputs.get
    out: dict[str, DataFrame] = {}
    history, preds, splits, energy = have("history"), have("predictions"), have("splits"), have("energy")
    if history is not None:
        out["learning_curves"] = learning_curves(history)
        out["lr_schedule"] = lr_schedule(history)
        out["epoch_time"] = epoch_time(history)
    if preds is not None:
        out["confusion"] = confusion_tables(preds, num_classes)
        out["roc"] = roc_table(preds)
        out["pr"] = pr_table(preds)
        out["per_class"] = per_class_table(preds, num_classes)
        out["baseline"] = baseline_table(preds, num_classes)
    if splits is not None:
        out["class_distribution"] = class_distribution(splits, label)
    if energy is not None:
        out["subband_energy"] = subband_energy_table(energy, label)
    for name in ("ablation", "permutation", "attribution"):
        table = have(name)
        if table is not None:
            out[name] = report_format(table)
    return out


def report_sizes(tables: Mapping[str, DataFrame], spark) -> DataFrame:
    """(report, n_rows) of built tables."""
    out = spark.createDataFrame([], "report string, n_rows long")
    for name, t in tables.items():
        out = out.unionByName(t.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n_rows")))
    return out

"""Everything derived from one prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import confusion as C
from flowloom.operators import curves as R
from flowloom.operators.bounds import side_by_side


def ranking_metrics(preds: DataFrame, num_classes: int) -> DataFrame:
    """Macro, weighted and micro AUC on renormalised scores, macro average precision: one row."""
    area = R.raw_and_renormalised_areas(preds, num_classes)
    cls, auc = F.col("class"), F.col("roc_auc")
    scaled = cls >= num_classes
    at_least_two = F.count_if(scaled) > 1
    weighted = F.sum(F.when(scaled, auc * F.col("n_pos"))) / F.sum(F.when(scaled, F.col("n_pos")))
    return area.agg(
        F.when(at_least_two, F.avg(F.when(scaled, auc))).alias("auc_macro"),
        F.when(at_least_two, weighted).alias("auc_weighted"),
        F.when(at_least_two, F.max(F.when(cls == R.MICRO, auc))).alias("auc_micro"),
        F.avg(F.when((cls >= 0) & ~scaled, F.col("pr_auc"))).alias("pr_auc_macro"),
    )


def summary_metrics(preds: DataFrame, num_classes: int, benign_code: int = 0) -> DataFrame:
    """The 19 summary metrics of a test run in one wide row."""
    cm = C.confusion_matrix(C.with_prediction(preds), num_classes)
    counts = C.class_summary(C.per_class(cm)).drop("macro_f1_all")
    binary = C.binary_view(cm, benign_code).select(F.col("FPR").alias("binary_fpr"))
    return side_by_side([counts, binary, C.log_loss(preds), ranking_metrics(preds, num_classes)])


def per_class_report(preds: DataFrame, num_classes: int) -> DataFrame:
    """Precision, recall, F1, FPR, ROC and PR areas per class."""
    pc = C.per_class(C.confusion_matrix(C.with_prediction(preds), num_classes))
    area = R.ovr_areas(preds).select("class", "roc_auc", "pr_auc")
    return pc.join(area, "class", "left").select(
        "class", "support", "precision", "recall", "f1", "fpr", "roc_auc", "pr_auc"
    )

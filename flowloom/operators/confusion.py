"""Metrics that follow from the class x class counts of a prediction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.numeric import ratio
from flowloom.functions.vectors import argmax_class, prob_of, squared_error

LOG_EPS = 2.0**-23  # machine epsilon of single-precision probabilities

# Published binary-view results this work is compared with.
PUBLISHED_BINARY = {
    "Accuracy": 0.9963,
    "Precision": 0.9798,
    "Recall": 0.9871,
    "F1": 0.9834,
    "FPR": 0.0818,
}


def with_prediction(preds: DataFrame, prob: str = "y_prob", out: str = "y_pred") -> DataFrame:
    return preds.withColumn(out, argmax_class(prob))


def confusion_matrix(
    preds: DataFrame, num_classes: int, true: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """K x K counts with zeros: (y_true, y_pred, n). The data meet one partial aggregate."""
    counts = preds.groupBy(F.col(true).cast("int").alias("y_true"), F.col(pred).cast("int").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    k = F.lit(num_classes)
    grid = preds.sparkSession.range(num_classes**2).select(
        F.floor(F.col("id") / k).cast("int").alias("y_true"),
        (F.col("id") % k).cast("int").alias("y_pred"),
        F.lit(0).cast("long").alias("n"),
    )
    return counts.unionByName(grid).groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))


def merge_confusions(parts: Sequence[DataFrame]) -> DataFrame:
    """Sum of confusion matrices of disjoint chunks."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))


def row_normalised(cm: DataFrame) -> DataFrame:
    """Share of each true class predicted as each class; 0 in empty rows."""
    row = F.sum("n").over(Window.partitionBy("y_true"))
    return cm.select("y_true", "y_pred", ratio(F.col("n"), row).alias("share"))


def confusion_wide(cm: DataFrame, num_classes: int, value: str = "n") -> DataFrame:
    """One row per true class, a column per predicted class."""
    return cm.groupBy("y_true").agg(
        *[F.max(F.when(F.col("y_pred") == c, F.col(value))).alias(f"pred_{c}") for c in range(num_classes)]
    )


def per_class(cm: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1 and one-vs-rest FPR of every class; empty divisions give 0."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    as_true = F.struct(F.col("y_true").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp"))
    as_pred = F.struct(F.col("y_pred").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp"))
    sums = (
        cm.select(F.inline(F.array(as_true, as_pred)))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )
    total = F.sum("support").over(Window.partitionBy(F.lit(0)))
    counted = sums.select(
        "*",
        (F.col("predicted") - F.col("tp")).alias("fp"),
        (F.col("support") - F.col("tp")).alias("fn"),
        (total - F.col("support") - F.col("predicted") + F.col("tp")).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + F.col("tn")).alias("fpr"),
    )


def _present(c: str | Column) -> Column:
    return F.when(F.col("support") > 0, F.col(c) if isinstance(c, str) else c)


def class_summary(pc: DataFrame) -> DataFrame:
    """One row of count-based summary metrics from ``per_class``; macro means over present classes."""
    t, p, tp = F.col("support").cast("double"), F.col("predicted").cast("double"), F.col("tp").cast("double")
    s, c = F.sum(t), F.sum(tp)
    spread = (s * s - F.sum(p * p)) * (s * s - F.sum(t * t))
    zero = F.lit(0.0)
    least = F.min_by(F.struct("class", "f1", "support"), F.when(F.col("support") > 0, F.struct("support", "class")))
    return pc.agg(
        ratio(c, s).alias("accuracy"),
        F.coalesce(F.avg(_present("recall")), zero).alias("balanced_accuracy"),
        F.coalesce(F.avg(_present("precision")), zero).alias("macro_precision"),
        F.coalesce(F.avg(_present("recall")), zero).alias("macro_recall"),
        F.coalesce(F.avg(_present("f1")), zero).alias("macro_f1"),
        F.coalesce(F.avg("f1"), zero).alias("macro_f1_all"),
        ratio(F.sum(t * F.col("f1")), s).alias("weighted_f1"),
        F.when(spread > 0, (c * s - F.sum(p * t)) / F.sqrt(spread)).otherwise(zero).alias("mcc"),
        F.coalesce(F.avg(_present("fpr")), zero).alias("macro_fpr"),
        least.alias("_least"),
        F.count(F.lit(1)).cast("int").alias("num_classes"),
        F.sum("support").alias("n_samples"),
    ).select(
        "*",
        F.col("_least.class").alias("minority_class"),
        F.col("_least.f1").alias("minority_f1"),
        F.col("_least.support").alias("minority_support"),
    ).drop("_least")


def binary_view(cm: DataFrame, benign_code: int) -> DataFrame:
    """Benign against attack, folded from the multiclass counts: one row."""
    t, p = F.col("y_true") != benign_code, F.col("y_pred") != benign_code
    n = F.col("n")
    cell = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    counts = cm.agg(
        cell(~t & ~p).alias("tn"), cell(~t & p).alias("fp"), cell(t & ~p).alias("fn"), cell(t & p).alias("tp")
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "*",
        ratio(tp + tn, tp + tn + fp + fn).alias("Accuracy"),
        ratio(tp, tp + fp).alias("Precision"),
        ratio(tp, tp + fn).alias("Recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("F1"),
        ratio(fp, fp + tn).alias("FPR"),
    )


def log_loss(preds: DataFrame, true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    p = F.greatest(F.lit(LOG_EPS), F.least(F.lit(1 - LOG_EPS), prob_of(prob, true)))
    return preds.agg(F.avg(-F.log(p)).alias("log_loss"))


def brier_loss(preds: DataFrame, num_classes: int, true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """Squared error against one-hot labels, summed over classes and averaged over all elements."""
    per_row = F.avg(squared_error(prob, true))
    return preds.agg(per_row.alias("mean_batch_sum_class"), (per_row / num_classes).alias("mean_elements"))


def batch_mean_loss(
    batched: DataFrame, num_classes: int, batch: str = "batch_id", true: str = "y_true", prob: str = "y_prob"
) -> DataFrame:
    """Unweighted mean over batches of the mean squared error; a short last batch counts fully."""
    per_batch = batched.groupBy(batch).agg((F.avg(squared_error(prob, true)) / num_classes).alias("_loss"))
    return per_batch.agg(F.avg("_loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def classification_report(pc: DataFrame, digits: int = 4) -> DataFrame:
    """Class rows, accuracy, macro and weighted averages over all classes."""
    scores = ("precision", "recall", "f1")
    n = F.sum("support")
    rows = pc.select(F.concat(F.lit("class_"), F.col("class").cast("string")).alias("row"), *scores, "support")
    acc = ratio(F.sum("tp"), n)
    accuracy = pc.agg(F.lit("accuracy").alias("row"), *[acc.alias(c) for c in scores], n.alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("row"), *[F.avg(c).alias(c) for c in scores], n.alias("support"))
    weighted = pc.agg(
        F.lit("weighted avg").alias("row"),
        *[ratio(F.sum(F.col(c) * F.col("support")), n).alias(c) for c in scores],
        n.alias("support"),
    )
    out = rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)
    return out.withColumns({c: F.round(c, digits) for c in scores})


def baseline_comparison(binary: DataFrame) -> DataFrame:
    """Our binary view next to the published values: (metric, ours, published, delta)."""
    structs = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("_v"), F.lit(v).alias("published"))
        for m, v in PUBLISHED_BINARY.items()
    ]
    return binary.select(F.inline(F.array(*structs))).select(
        "metric",
        F.round("_v", 6).alias("ours"),
        "published",
        F.round(F.col("_v") - F.col("published"), 6).alias("delta"),
    )

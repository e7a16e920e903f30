"""Queries: metrics of a prediction table."""

from pyspark.sql import functions as F

from flowloom.functions.vectors import softmax
from flowloom.operators import confusion as C
from flowloom.operators.sampling import epoch_batches
from flowloom.plans.evaluate import summary_metrics as summary
from flowloom.workload.inputs import K, logits, preds, SEED, table, vectors, with_
from flowloom.workload.registry import query, r
from flowloom.workload.curves import AP_CTE, AREA_CTE, RENORM_CTE


def hard(spark, sf):
    return C.with_prediction(preds(spark, sf))


def cm(spark, sf):
    return C.confusion_matrix(hard(spark, sf), K)


def pc(spark, sf):
    return C.per_class(cm(spark, sf))


def _round(df, *skip):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query("softmax_array", with_("expo") + f"SELECT row_key, u.i::INT AS pos, {r('ex[u.i + 1] / list_sum(ex)')} AS p FROM expo, (SELECT unnest(range(0, {K})) AS i) u")
def softmax_array(spark, sf):
    v = vectors(spark, sf).select("row_key", softmax(logits()).alias("p"))
    return v.select("row_key", F.posexplode("p").alias("pos", "p")).withColumn("p", F.round("p", 6))


@query("argmax_class", with_("hard") + "SELECT row_key, y_pred FROM hard")
def argmax_class(spark, sf):
    return hard(spark, sf).select("row_key", "y_pred")


@query("confusion_matrix", with_("cm") + "SELECT y_true, y_pred, n FROM cm")
def confusion_matrix(spark, sf):
    return cm(spark, sf)


@query("confusion_labels", "SELECT a.v AS y_true, b.v AS y_pred, (SELECT count(*) FROM labels WHERE quality = a.v AND toxic = b.v) AS n "
       "FROM (SELECT unnest([0, 1]) AS v) a CROSS JOIN (SELECT unnest([0, 1]) AS v) b")
def confusion_labels(spark, sf):
    return C.confusion_matrix(table(spark, sf, "labels"), 2, "quality", "toxic")


@query("confusion_row_norm", with_("cm") + f"""SELECT y_true, y_pred,
 {r('CASE WHEN sum(n) OVER (PARTITION BY y_true) > 0 THEN n::DOUBLE / sum(n) OVER (PARTITION BY y_true) ELSE 0 END')} AS share FROM cm""")
def confusion_row_norm(spark, sf):
    return _round(C.row_normalised(cm(spark, sf)))


@query("per_class_prf", with_("pc") + f"SELECT class, support, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM pc")
def per_class_prf(spark, sf):
    return _round(pc(spark, sf).select("class", "support", "precision", "recall", "f1"))


@query("fpr_per_class", with_("pc") + f"SELECT class, fp, tn, {r('fpr')} AS fpr FROM pc")
def fpr_per_class(spark, sf):
    return _round(pc(spark, sf).select("class", "fp", "tn", "fpr"))


_SUMMARY = {
    "accuracy": "sum(tp)::DOUBLE / sum(support)",
    "balanced_accuracy": "avg(recall) FILTER (support > 0)",
    "macro_precision": "avg(precision) FILTER (support > 0)",
    "macro_recall": "avg(recall) FILTER (support > 0)",
    "macro_f1": "avg(f1) FILTER (support > 0)",
    "macro_f1_all": "avg(f1)",
    "weighted_f1": "sum(support * f1) / sum(support)",
    "mcc": """(sum(tp)::DOUBLE * sum(support) - sum(predicted::DOUBLE * support))
 / sqrt((sum(support)::DOUBLE ** 2 - sum(predicted::DOUBLE ** 2)) * (sum(support)::DOUBLE ** 2 - sum(support::DOUBLE ** 2)))""",
    "macro_fpr": "avg(fpr) FILTER (support > 0)",
}


def _picked(*names: str) -> str:
    return with_("pc") + "SELECT " + ", ".join(f"{r(_SUMMARY[n])} AS {n}" for n in names) + " FROM pc"


def _summary(spark, sf, *names):
    return _round(C.class_summary(pc(spark, sf)).select(*names))


@query("accuracy", _picked("accuracy"))
def accuracy(spark, sf):
    return _summary(spark, sf, "accuracy")


@query("balanced_accuracy", _picked("balanced_accuracy"))
def balanced_accuracy(spark, sf):
    return _summary(spark, sf, "balanced_accuracy")


@query("macro_prf", _picked("macro_precision", "macro_recall", "macro_f1", "macro_f1_all"))
def macro_prf(spark, sf):
    return _summary(spark, sf, "macro_precision", "macro_recall", "macro_f1", "macro_f1_all")


@query("weighted_f1", _picked("weighted_f1"))
def weighted_f1(spark, sf):
    return _summary(spark, sf, "weighted_f1")


@query("mcc", _picked("mcc"))
def mcc(spark, sf):
    return _summary(spark, sf, "mcc")


@query("macro_fpr", _picked("macro_fpr"))
def macro_fpr(spark, sf):
    return _summary(spark, sf, "macro_fpr")


_MINORITY = f"SELECT class AS minority_class, {r('f1')} AS minority_f1, support AS minority_support FROM pc WHERE support > 0 ORDER BY support, class LIMIT 1"


@query("minority_class", with_("pc") + _MINORITY)
def minority_class(spark, sf):
    return _summary(spark, sf, "minority_class", "minority_f1", "minority_support")


_BIN_CTE = """bin AS (SELECT coalesce(sum(n) FILTER (y_true = 0 AND y_pred = 0), 0)::BIGINT AS tn, coalesce(sum(n) FILTER (y_true = 0 AND y_pred <> 0), 0)::BIGINT AS fp,
 coalesce(sum(n) FILTER (y_true <> 0 AND y_pred = 0), 0)::BIGINT AS fn, coalesce(sum(n) FILTER (y_true <> 0 AND y_pred <> 0), 0)::BIGINT AS tp FROM cm)"""
_BIN = {
    "Accuracy": "(tp + tn)::DOUBLE / (tp + tn + fp + fn)",
    "Precision": "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END",
    "Recall": "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END",
    "F1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END",
    "FPR": "CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END",
}


@query("binary_view", with_("cm", more=_BIN_CTE) + "SELECT tn, fp, fn, tp, " + ", ".join(f"{r(e)} AS \"{m}\"" for m, e in _BIN.items()) + " FROM bin")
def binary_view(spark, sf):
    return _round(C.binary_view(cm(spark, sf), 0))


_LL = "avg(-ln(greatest(pow(2.0, -23), least(1 - pow(2.0, -23), y_prob[y_true + 1]::DOUBLE))))"


@query("log_loss", with_("preds") + f"SELECT {r(_LL)} AS log_loss FROM preds")
def log_loss(spark, sf):
    return _round(C.log_loss(preds(spark, sf)))


_SE = "list_sum(list_transform(y_prob, lambda v: v::DOUBLE * v::DOUBLE)) - 2 * y_prob[y_true + 1]::DOUBLE + 1"


@query("brier_loss", with_("preds") + f"SELECT {r(f'avg({_SE})')} AS mean_batch_sum_class, {r(f'avg({_SE}) / {K}')} AS mean_elements FROM preds")
def brier_loss(spark, sf):
    return _round(C.brier_loss(preds(spark, sf), K))


@query("batch_mean_loss", with_("preds", more=f"b AS (SELECT *, (row_number() OVER (ORDER BY md5('{SEED}|1|' || row_key), row_key) - 1) // 128 AS batch_id FROM preds)")
       + f"SELECT {r('avg(l)')} AS loss, count(*) AS n_batches FROM (SELECT avg({_SE}) / {K} AS l FROM b GROUP BY batch_id)")
def batch_mean_loss(spark, sf):
    batched = epoch_batches(preds(spark, sf), "row_key", 128, epoch=1, seed=SEED)
    return _round(C.batch_mean_loss(batched, K))


@query("classification_report", with_("pc") + f"""SELECT 'class_' || class AS row, {r('precision', 4)} AS precision, {r('recall', 4)} AS recall, {r('f1', 4)} AS f1, support FROM pc
 UNION ALL SELECT 'accuracy', {r(_SUMMARY['accuracy'], 4)}, {r(_SUMMARY['accuracy'], 4)}, {r(_SUMMARY['accuracy'], 4)}, sum(support)::BIGINT FROM pc
 UNION ALL SELECT 'macro avg', {r('avg(precision)', 4)}, {r('avg(recall)', 4)}, {r('avg(f1)', 4)}, sum(support)::BIGINT FROM pc
 UNION ALL SELECT 'weighted avg', {r('sum(precision * support) / sum(support)', 4)}, {r('sum(recall * support) / sum(support)', 4)},
 {r('sum(f1 * support) / sum(support)', 4)}, sum(support)::BIGINT FROM pc""")
def classification_report(spark, sf):
    return C.classification_report(pc(spark, sf))


BASELINE_SQL = with_("cm", more=_BIN_CTE) + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {r(_BIN[m])} AS ours, {v}::DOUBLE AS published, {r(f'{_BIN[m]} - {v}::DOUBLE')} AS delta FROM bin"
    for m, v in C.PUBLISHED_BINARY.items()
)


@query("baseline_comparison", BASELINE_SQL)
def baseline_comparison(spark, sf):
    return C.baseline_comparison(C.binary_view(cm(spark, sf), 0))


_WIDE = ", ".join(f"(SELECT {r(e)} FROM pc) AS {n}" for n, e in _SUMMARY.items() if n != "macro_f1_all")


@query("summary_metrics", with_("pc", "counts", more=f"{_BIN_CTE}, {AREA_CTE}, {AP_CTE}, {RENORM_CTE}, mino AS ({_MINORITY})") + f"""SELECT {_WIDE},
 {K} AS num_classes, (SELECT count(*) FROM preds) AS n_samples, minority_class, minority_f1, minority_support,
 (SELECT {r(_BIN['FPR'])} FROM bin) AS binary_fpr, (SELECT {r(_LL)} FROM preds) AS log_loss,
 (SELECT {r('avg(auc)')} FROM renorm_area WHERE class >= 0) AS auc_macro,
 (SELECT {r('sum(auc * np) / sum(np)')} FROM renorm_area WHERE class >= 0) AS auc_weighted,
 (SELECT {r('auc')} FROM renorm_area WHERE class = -1) AS auc_micro,
 (SELECT {r('avg(ap)')} FROM ap WHERE class >= 0) AS pr_auc_macro FROM mino""")
def summary_metrics(spark, sf):
    return _round(summary(preds(spark, sf), K))

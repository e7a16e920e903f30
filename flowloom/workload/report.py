"""Queries: report tables."""

from pyspark.sql import functions as F

from flowloom.plans import report as P
from flowloom.sources.sinks import report_format
from flowloom.workload import attribution as I
from flowloom.workload.curves import _CUM, _PR, _PR_COLS, _ROC, _ROC_COLS, AP_CTE, AREA_CTE, MACRO_CTES
from flowloom.workload.inputs import K, flow_split, history, preds, with_
from flowloom.workload.metrics import BASELINE_SQL
from flowloom.workload.registry import SQL, query, r
from flowloom.workload.wavelet import SHARE_SQL, energy

_H = ("learning_rate", "train_mse_loss", "val_mse_loss", "train_accuracy", "epoch_seconds", "samples_per_second", "peak_rss_mb")


@query("rpt_learning_curves", with_("history") + "SELECT epoch, session_id, " + ", ".join(f"{r(c)} AS {c}" for c in _H) + ", is_partial, resumed_after, progress FROM history")
def rpt_learning_curves(spark, sf):
    return P.learning_curves(history(spark, sf))


@query("rpt_lr_schedule", with_("history") + f"SELECT epoch, {r('learning_rate')} AS learning_rate FROM history")
def rpt_lr_schedule(spark, sf):
    return report_format(P.lr_schedule(history(spark, sf)))


_SHARE = "CASE WHEN sum(n) > 0 THEN coalesce(sum(n) FILTER (y_pred = {c}), 0)::DOUBLE / sum(n) ELSE 0 END"


@query("rpt_confusion_wide", with_("cm") + "SELECT y_true, " + ", ".join(f"sum(n) FILTER (y_pred = {c})::BIGINT AS pred_{c}" for c in range(K)) + ", "
       + ", ".join(f"{r(_SHARE.format(c=c))} AS share_{c}" for c in range(K)) + " FROM cm GROUP BY 1")
def rpt_confusion_wide(spark, sf):
    return P.confusion_tables(preds(spark, sf), K)


@query("rpt_roc", with_("counts_micro", more=f"{MACRO_CTES}, {_ROC}") + f"""SELECT {_ROC_COLS} FROM roc
 UNION ALL SELECT -2, g, {r('g::DOUBLE / 999')}, {r('tpr')}, 0 FROM strips""")
def rpt_roc(spark, sf):
    return P.roc_table(preds(spark, sf))


@query("rpt_pr", with_("counts_micro", more=f"{_CUM}, {_PR}") + f"SELECT {_PR_COLS} FROM pr")
def rpt_pr(spark, sf):
    return P.pr_table(preds(spark, sf))


@query("rpt_per_class", with_("pc", "counts", more=f"{AREA_CTE}, {AP_CTE}") + "SELECT class, support, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("precision", "recall", "f1", "fpr")) + f", {r('auc')} AS roc_auc, {r('ap')} AS pr_auc FROM pc JOIN area USING (class) JOIN ap USING (class)")
def rpt_per_class(spark, sf):
    return P.per_class_table(preds(spark, sf), K)


@query("rpt_class_distribution", with_("split") + """SELECT label, count(*) FILTER (split = 'train') AS train,
 count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM split GROUP BY 1""")
def rpt_class_distribution(spark, sf):
    return P.class_distribution(flow_split(spark, sf), "label")


@query("rpt_epoch_time", with_("history") + f"""SELECT epoch, session_id, {r('epoch_seconds')} AS epoch_seconds, {r('samples_per_second')} AS samples_per_second,
 (dense_rank() OVER (ORDER BY f))::INT AS session_ordinal FROM (SELECT *, min(epoch) OVER (PARTITION BY session_id) AS f FROM history)""")
def rpt_epoch_time(spark, sf):
    return P.epoch_time(history(spark, sf))


@query("rpt_subband_energy", SHARE_SQL)
def rpt_subband_energy(spark, sf):
    return P.subband_energy_table(energy(spark, sf), "y_true")


@query("rpt_ablation", I.ABLATION_SQL)
def rpt_ablation(spark, sf):
    return report_format(I.ablation(spark, sf)).withColumn("drop_percent", F.round("drop_percent", 4))


@query("rpt_permutation", I.PERMUTATION_SQL)
def rpt_permutation(spark, sf):
    return report_format(I.permutation_importance(spark, sf))


@query("rpt_attribution", I.FOLD_SQL)
def rpt_attribution(spark, sf):
    return report_format(I.folded(spark, sf))


@query("rpt_baseline", BASELINE_SQL)
def rpt_baseline(spark, sf):
    return P.baseline_table(preds(spark, sf), K)


_TABLES = ("learning_curves", "lr_schedule", "epoch_time", "confusion", "roc", "pr", "per_class", "baseline", "class_distribution",
           "subband_energy", "ablation", "permutation", "attribution")
REPORT_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS report, count(*) AS n_rows FROM ({SQL['rpt_confusion_wide' if t == 'confusion' else f'rpt_{t}']})" for t in _TABLES
)


@query("report_all", REPORT_SQL)
def report_all(spark, sf):
    inputs = {
        "history": history(spark, sf),
        "predictions": preds(spark, sf),
        "splits": flow_split(spark, sf),
        "energy": energy(spark, sf).withColumnRenamed("y_true", "label"),
        "ablation": I.ablation(spark, sf),
        "permutation": I.permutation_importance(spark, sf),
        "attribution": I.folded(spark, sf),
    }
    return P.report_sizes(P.report_all(inputs, K, "label"), spark)

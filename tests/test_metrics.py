import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import confusion as C
from flowloom.operators import curves as R
from flowloom.plans import evaluate as V
from flowloom.plans import report as P


def preds_of(spark, y, p):
    rows = [(i, int(t), [float(np.float32(v)) for v in q]) for i, (t, q) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "row_key long, y_true int, y_prob array<float>")


def random_preds(n=800, k=5, seed=0, levels=None, classes=None):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes or k, n)
    p = rng.random((n, k))
    p[np.arange(n), y] *= 1.5
    p /= p.sum(axis=1, keepdims=True)
    if levels:
        p = np.round(p * levels) / levels
    return y, p.astype(np.float32)


def cm_of(spark, cm):
    return spark.createDataFrame([(i, j, int(n)) for i, row in enumerate(cm) for j, n in enumerate(row)], "y_true int, y_pred int, n long")


def pairwise_auc(pos, neg):
    d = pos[:, None] - neg[None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


def running(y, s):
    """(threshold, fp, tp) from the highest score down."""
    out = []
    for t in sorted(set(s), reverse=True):
        out.append((t, int(((s >= t) & (y == 0)).sum()), int(((s >= t) & (y == 1)).sum())))
    return out


def test_fpr_golden(spark):
    pc = {r["class"]: r for r in C.per_class(cm_of(spark, [[8, 2, 0], [1, 7, 2], [0, 3, 7]])).collect()}
    assert pc[0].fpr == pytest.approx(1 / 20) and pc[1].fpr == pytest.approx(5 / 20)


def test_binary_golden(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 2, 1], [0, 1, 1, 2, 0])), "y_true int, y_pred int")
    b = C.binary_view(C.confusion_matrix(df, 3), 0).first()
    assert (b.tn, b.fp, b.fn, b.tp) == (1, 1, 1, 2)
    assert b.FPR == 0.5 and b.Recall == pytest.approx(2 / 3)
    assert C.baseline_comparison(C.binary_view(C.confusion_matrix(df, 3), 0)).count() == 5


def test_present_and_all_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "y_true int, y_pred int")
    s = C.class_summary(C.per_class(C.confusion_matrix(df, 4))).first()
    assert s.macro_f1 == 1.0 and s.macro_f1_all == 0.5
    assert (s.minority_class, s.minority_support) == (0, 2)


def test_constant_predictor_and_empty_row(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "y_true int, y_pred int")
    assert C.class_summary(C.per_class(C.confusion_matrix(df, 3))).first().mcc == 0
    shares = C.row_normalised(cm_of(spark, [[5, 1], [0, 0]])).collect()
    assert all(r.share == r.share for r in shares) and sum(r.share for r in shares) == pytest.approx(1)


def test_merged_chunks(spark):
    y, p = random_preds(60, 3)
    df = C.with_prediction(preds_of(spark, y, p))
    parts = [C.confusion_matrix(df.filter(F.col("row_key") % 3 == i), 3) for i in range(3)]
    assert sorted(C.merge_confusions(parts).collect()) == sorted(C.confusion_matrix(df, 3).collect())


def test_losses(spark):
    k = 18
    flat = preds_of(spark, [0, 3, 5, 17], np.full((4, k), 1 / k))
    b = C.brier_loss(flat, k).first()
    assert b.mean_batch_sum_class == pytest.approx(k * b.mean_elements)
    assert b.mean_elements == pytest.approx(((1 - 1 / k) ** 2 + (k - 1) / k**2) / k, abs=1e-6)
    sure = preds_of(spark, [0, 3], np.eye(k)[[0, 3]])
    assert C.brier_loss(sure, k).first().mean_elements == pytest.approx(0)
    assert C.log_loss(sure).first()[0] == pytest.approx(0, abs=1e-6)
    wrong = preds_of(spark, [1], np.eye(2)[[0]])
    assert C.log_loss(wrong).first()[0] == pytest.approx(-np.log(2.0**-23))


def test_counts_against_brute_force(spark):
    y, p = random_preds(400, 5, 3)
    pred = p.argmax(axis=1)
    cm = np.zeros((5, 5), int)
    np.add.at(cm, (y, pred), 1)
    got = {(r.y_true, r.y_pred): r.n for r in C.confusion_matrix(C.with_prediction(preds_of(spark, y, p)), 5).collect()}
    assert all(got[i, j] == cm[i, j] for i in range(5) for j in range(5))
    s = V.summary_metrics(preds_of(spark, y, p), 5).first()
    rec = np.diag(cm) / cm.sum(axis=1)
    assert s.accuracy == pytest.approx((y == pred).mean()) and s.balanced_accuracy == pytest.approx(rec.mean())
    # multiclass Matthews as the correlation of one-hot labels and predictions
    a, b = np.eye(5)[y], np.eye(5)[pred]
    cov = lambda u, v: ((u - u.mean(0)) * (v - v.mean(0))).sum()
    assert s.mcc == pytest.approx(cov(a, b) / np.sqrt(cov(a, a) * cov(b, b)))


@pytest.mark.parametrize("levels", [None, 7])
def test_areas_against_pairs(spark, levels):
    y, p = random_preds(300, 4, 5, levels)
    got = {r["class"]: r for r in R.ovr_areas(preds_of(spark, y, p)).collect()}
    for c in range(4):
        s = p[:, c].astype(np.float64)
        assert got[c].roc_auc == pytest.approx(pairwise_auc(s[y == c], s[y != c]))
        prev, ap = 0.0, 0.0
        for _, fp, tp in running((y == c).astype(int), s):
            recall = tp / (y == c).sum()
            ap += (recall - prev) * tp / (tp + fp)
            prev = recall
        assert got[c].pr_auc == pytest.approx(ap)


def test_absent_class(spark):
    y, p = random_preds(200, 4, 6, classes=3)
    df = preds_of(spark, y, p)
    got = {r["class"]: r for r in R.ovr_areas(df).collect()}
    assert got[3].roc_auc is None and got[3].pr_auc is None
    m = R.auc_macro_weighted(df, 4).first()
    assert (m.classes_used, m.classes_skipped) == (3, 1)
    q = p[:, :3].astype(np.float64)
    q = (q / q.sum(axis=1, keepdims=True)).astype(np.float32)
    each = [pairwise_auc(q[y == c, c], q[y != c, c]) for c in range(3)]
    assert m.auc_macro == pytest.approx(np.mean(each))
    assert m.auc_weighted == pytest.approx(np.average(each, weights=np.bincount(y)))
    flat = np.eye(3)[y].ravel()
    assert R.auc_micro(df).first()[0] == pytest.approx(pairwise_auc(q.ravel()[flat == 1], q.ravel()[flat == 0]))
    s = V.ranking_metrics(df, 4).first()
    assert s.auc_macro == pytest.approx(m.auc_macro) and s.auc_weighted == pytest.approx(m.auc_weighted)
    assert 3 not in {r["class"] for r in R.roc_points(df).collect()}


def test_single_class_has_no_auc(spark):
    df = preds_of(spark, [1, 1], np.array([[0.2, 0.8], [0.4, 0.6]]))
    assert R.auc_macro_weighted(df, 2).first().auc_macro is None
    assert R.auc_micro(df).first().auc_micro is None


def test_roc_and_pr_points(spark):
    y, p = random_preds(150, 3, 8, levels=20)
    df = preds_of(spark, y, p)
    roc, pr = R.roc_points(df).collect(), R.pr_points(df).collect()
    for c in range(3):
        s, t = p[:, c], (y == c).astype(int)
        run = running(t, s)
        steps = np.diff([[0, 0]] + [[fp, tp] for _, fp, tp in run], axis=0)
        keep = [i for i in range(len(run)) if i in (0, len(run) - 1) or tuple(steps[i]) != tuple(steps[i + 1])]
        want = [(0.0, 0.0)] + [(run[i][1] / (t == 0).sum(), run[i][2] / t.sum()) for i in keep]
        got = sorted((r.idx, r.fpr, r.tpr) for r in roc if r["class"] == c)
        assert [g[0] for g in got] == list(range(len(want)))
        assert np.allclose([g[1:] for g in got], want)
        wpr = [(tp / t.sum(), tp / (tp + fp)) for _, fp, tp in reversed(run)] + [(0.0, 1.0)]
        gpr = sorted((r.idx, r.recall, r.precision) for r in pr if r["class"] == c)
        assert [g[0] for g in gpr] == list(range(len(wpr)))
        assert np.allclose([g[1:] for g in gpr], wpr)
    assert {r["class"] for r in roc} == {0, 1, 2, R.MICRO}


@pytest.mark.parametrize("n_points, k", [(7, 10), (10, 10), (101, 10), (2500, 40)])
def test_thinning(spark, n_points, k):
    pts = spark.range(n_points).select(F.lit(0).alias("class"), F.col("id").alias("idx"), F.lit(n_points).cast("long").alias("n_points"))
    got = sorted(r.idx for r in R.thin_points(pts, k).collect())
    want = list(range(n_points)) if n_points <= k else sorted({i * (n_points - 1) // (k - 1) for i in range(k)})
    assert got == want


def test_macro_roc(spark):
    y, p = random_preds(120, 3, 9, levels=12)
    got = sorted((r.idx, r.tpr, r.auc) for r in R.macro_roc(preds_of(spark, y, p)).collect())
    grid = np.linspace(0, 1, R.GRID)
    curves = []
    for c in range(3):
        run = running((y == c).astype(int), p[:, c])
        x = [0.0] + [fp / (y != c).sum() for _, fp, _ in run]
        curves.append(np.interp(grid, x, [0.0] + [tp / (y == c).sum() for _, _, tp in run]))
    want = np.mean(curves, axis=0)
    assert np.abs(np.array([g[1] for g in got]) - want).max() < 1e-6
    assert got[0][2] == pytest.approx(np.trapezoid(want, grid), abs=1e-6)


def test_binned_auc_is_close(spark):
    y, p = random_preds(400, 4, 11)
    exact = {r["class"]: r.roc_auc for r in R.ovr_areas(preds_of(spark, y, p)).collect()}
    approx = {r["class"]: r.roc_auc for r in R.approx_auc(preds_of(spark, y, p)).collect()}
    assert all(abs(exact[c] - approx[c]) < 2e-3 for c in exact)


def test_scores_at_the_ends(spark):
    y = [0, 1, 0, 1]
    p = np.array([[1, 0], [0, 1], [0.5, 0.5], [0.5, 0.5]])
    got = {r["class"]: r.roc_auc for r in R.ovr_areas(preds_of(spark, y, p)).collect()}
    assert got == {0: 0.875, 1: 0.875}


def test_equal_scores_for_a_third_of_the_rows(spark):
    y, p = random_preds(300, 3, 12)
    p[:100] = np.float32(1 / 3)
    got = {r["class"]: r.roc_auc for r in R.ovr_areas(preds_of(spark, y, p)).collect()}
    assert all(got[c] == pytest.approx(pairwise_auc(p[y == c, c].astype(float), p[y != c, c].astype(float))) for c in range(3))


def test_same_for_any_layout(spark):
    y, p = random_preds(200, 4, 13)
    df = preds_of(spark, y, p)
    a, b = (V.per_class_report(df.repartition(n), 4).orderBy("class").collect() for n in (1, 7))
    assert [tuple(x) for x in a] == [pytest.approx(tuple(x)) for x in b]


def test_reports_skip_missing_inputs(spark):
    y, p = random_preds(60, 3)
    tables = P.report_all({"predictions": preds_of(spark, y, p), "history": None}, 3)
    assert set(tables) == {"confusion", "roc", "pr", "per_class", "baseline"}
    sizes = dict(P.report_sizes(tables, spark).collect())
    assert sizes["confusion"] == 3 and sizes["per_class"] == 3 and sizes["baseline"] == 5
    assert {r["row"] for r in C.classification_report(C.per_class(C.confusion_matrix(C.with_prediction(preds_of(spark, y, p)), 3))).collect()} >= {"accuracy", "macro avg", "weighted avg"}

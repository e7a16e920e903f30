"""Area within a tolerance, on scores that equal bins cannot tell apart."""

import numpy as np
import pytest

from flowloom.operators import areas as R
from flowloom.operators import curves as C


def preds_of(spark, y, p):
    return spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, p)], "y_true int, y_prob array<float>")


def scores(kind, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    z = rng.normal(y * 1.5, 1)
    p = {
        "crowded at 0": 1e-20 * np.exp(z), "crowded at 1": 1 - 3e-6 * np.exp(-z), "middle": 0.3 + 1e-5 * z,
        "spread": 1 / (1 + np.exp(-z)), "few": np.round(1 / (1 + np.exp(-z)), 1), "ends": (z > 0).astype(float),
    }[kind].astype(np.float32)
    return y, np.stack([1 - p, p], 1)


@pytest.mark.parametrize("kind", ["crowded at 0", "crowded at 1", "middle", "spread", "few", "ends"])
@pytest.mark.parametrize("tolerance", [1e-1, 1e-2, 1e-4])
def test_error_within_the_bound(spark, kind, tolerance):
    df = preds_of(spark, *scores(kind))
    exact = {r["class"]: r.roc_auc for r in C.ovr_areas(df).collect()}
    for r in R.bounded_auc(df, tolerance).collect():
        assert r.error_bound <= tolerance
        assert abs(r.roc_auc - exact[r["class"]]) <= r.error_bound + 1e-12


def test_same_for_any_layout(spark):
    df = preds_of(spark, *scores("middle"))
    want = sorted(R.bounded_auc(df).collect())
    assert sorted(R.bounded_auc(df.repartition(9)).collect()) == want


def test_few_rows_leave_the_aggregate(spark):
    """Heavy cells are bounded by the tolerance, not by the rows or their scores."""
    df = preds_of(spark, *scores("middle"))
    exact, loose = R.bounded_auc(df, 1e-4).collect(), R.bounded_auc(df, 0.4).collect()
    assert all(r.error_bound < 1e-4 for r in exact) and any(r.error_bound > 1e-3 for r in loose)


def test_odd_rows(spark):
    df = spark.createDataFrame([(0, [0.5, None]), (None, [0.1, 0.9]), (1, None), (1, [0.2, 0.8]), (0, [1.0, 0.0])], "y_true int, y_prob array<float>")
    got = {r["class"]: (r.n_pos, r.n_neg, r.roc_auc) for r in R.bounded_auc(df).collect()}
    assert got == {0: (2, 1, 1.0), 1: (1, 1, 1.0)}
    assert R.bounded_auc(df.limit(0)).collect() == []
    one = spark.createDataFrame([(0, [0.5, 0.5])], "y_true int, y_prob array<float>")
    assert all(r.roc_auc is None for r in R.bounded_auc(one).collect())
    with pytest.raises(ValueError):
        R.bounded_auc(df, 0)

"""Shapley values and the distributed Newton fit against plain versions."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import logistic, shapley
from flowloom.operators import scoring as S


def table_of(spark, x, y=None):
    y = np.zeros(len(x), int) if y is None else y
    rows = [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "row_key long, y_true int, features array<double>")


def crooked(width, k=3, seed=0):
    """A scorer in which all features interact."""
    w = np.random.default_rng(seed).normal(0, 1, (width, k))
    return lambda x: S.row_softmax(np.tanh(x @ w) * 2 + (x**2 @ np.abs(w)) / 3)


def plain_values(x, background, scorer):
    """Mean over all orders of the features, one by one."""
    width = x.shape[1]
    out, count = 0, 0
    for order in permutations(range(width)):
        part = np.zeros((len(x), width, scorer(x[:1]).shape[1]))
        for i, row in enumerate(x):
            mixed = background.copy()
            last = scorer(mixed).mean(axis=0)
            for j in order:
                mixed[:, j] = row[j]
                now = scorer(mixed).mean(axis=0)
                part[i, j], last = now - last, now
        out, count = out + part, count + 1
    return out / count


def test_enumeration_is_the_mean_over_all_orders():
    rng = np.random.default_rng(1)
    x, b, f = rng.normal(0, 1, (3, 5)), rng.normal(0, 1, (4, 5)), crooked(5)
    assert np.allclose(shapley.by_enumeration(x, b, f), plain_values(x, b, f), atol=1e-12)


def test_eight_features_sampled_close_to_all_coalitions():
    rng = np.random.default_rng(2)
    x, b, f = rng.normal(0, 1, (6, 8)), rng.normal(0, 1, (10, 8)), crooked(8)
    exact = shapley.by_enumeration(x, b, f)
    error = [np.abs(shapley.by_walks(x, b, f, shapley.walks(8, n, 5)) - exact).max() for n in (4, 400)]
    assert error[1] < 0.01 and error[1] < error[0]
    pairs = lambda m: np.stack([m[:, 0] * m[:, 1] + m[:, 2], m[:, 3] * m[:, 7] - m[:, 5] ** 2], axis=1)
    # No more than two features interact: one order and its reverse are enough.
    assert np.allclose(shapley.by_walks(x, b, pairs, shapley.walks(8, 1, 0)), shapley.by_enumeration(x, b, pairs), atol=1e-12)


@pytest.mark.parametrize("orders", [None, 3])
def test_values_add_up_and_only_sums_leave_a_task(spark, orders, monkeypatch):
    monkeypatch.setattr(shapley, "SCORED_ROWS", 40)
    rng = np.random.default_rng(3)
    x, f = rng.normal(0, 1, (50, 8)), crooked(8)
    df = table_of(spark, x)
    b = shapley.background_rows(df, 12, seed=7)
    assert b.shape == (12, 8) and all((x == r).all(axis=1).any() for r in b)
    got = shapley.shapley_sums(df.repartition(3), f, b, orders).collect()
    assert len(got) == 8 * 3 and {r.n for r in got} == {50}
    want = f(x).sum(axis=0) - 50 * f(b).mean(axis=0)
    assert [sum(r.value for r in got if r["class"] == c) for c in range(3)] == pytest.approx(want, abs=1e-9)
    if orders is None:
        exact = shapley.by_enumeration(x, b, f)
        assert all(r.abs_value == pytest.approx(np.abs(exact[:, r.pos, r["class"]]).sum()) for r in got)
    ranked = shapley.shapley_attribution(df, f, b, orders, names=[f"n{i}" for i in range(8)]).collect()
    assert sum(r.percent for r in ranked) == pytest.approx(100) and sorted(r["rank"] for r in ranked) == list(range(1, 9))


def test_too_many_features_to_enumerate_and_no_background(spark):
    with pytest.raises(ValueError):
        shapley.by_enumeration(np.zeros((1, 17)), np.zeros((1, 17)), crooked(17))
    with pytest.raises(ValueError):
        shapley.background_rows(table_of(spark, np.zeros((2, 3))), 0)
    assert shapley.shapley_sums(table_of(spark, np.zeros((0, 3))), crooked(3), np.zeros((2, 3))).collect() == []


def plain_fit(x, y, k, reg, steps=60):
    """Newton in plain numpy on the whole matrix."""
    n, d = len(x), x.shape[1] + 1
    x1 = np.hstack([np.ones((n, 1)), x])
    w = np.zeros(((k - 1), d))
    pen = np.tile(np.r_[0, np.full(d - 1, reg)], k - 1)
    for _ in range(steps):
        z = np.hstack([np.zeros((n, 1)), x1 @ w.T])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True))[:, 1:]
        g = ((p - (y[:, None] == np.arange(1, k))).T @ x1 / n).ravel() + pen * w.ravel()
        h = np.zeros((w.size, w.size))
        for i in range(n):
            h += np.kron(np.diag(p[i]) - np.outer(p[i], p[i]), np.outer(x1[i], x1[i])) / n
        w = w - np.linalg.solve(h + np.diag(pen), g).reshape(w.shape)
    return w


@pytest.mark.parametrize("k, seed", [(2, 0), (4, 1)])
def test_fit_equals_numpy(spark, k, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, 240)
    x = rng.normal(0, 1, (240, 5)) + np.eye(k, 5)[y]
    df = table_of(spark, x, y)
    a, b = (logistic.fit_logistic(rows, k, 5, reg=0.02) for rows in (df, df.repartition(9)))
    assert np.abs(a.weights[1:] - plain_fit(x, y, k, 0.02, 12)).max() < 1e-6
    assert np.abs(a.weights - b.weights).max() < 1e-9 and 0 < a.steps < 12
    scored = S.score_in_batches(df, a, 5)
    assert scored.where(F.array_position("y_prob", F.array_max("y_prob")) - 1 == F.col("y_true")).count() > 240 / k


def test_separable_rows_stay_finite_and_bounds_hold(spark):
    x = np.array([[-5.0], [-4.0], [4.0], [5.0]])
    model = logistic.fit_logistic(table_of(spark, x, np.array([0, 0, 1, 1])), 2, 1, reg=1e-6)
    assert np.isfinite(model.weights).all() and (model(x).argmax(axis=1) == [0, 0, 1, 1]).all()
    with pytest.raises(ValueError):
        logistic.fit_logistic(table_of(spark, x), 100, 100)
    with pytest.raises(ValueError):
        logistic.fit_logistic(table_of(spark, np.zeros((0, 1))), 2, 1)

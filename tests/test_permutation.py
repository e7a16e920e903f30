"""Permutation over all rows: the same for any block, layout and size, and equal to a plain version."""

import hashlib

import numpy as np
import pytest

from flowloom.operators import attribution as I
from flowloom.operators import scoring as S


def macro_f1(y, p):
    return np.mean([2 * ((y == c) & (p == c)).sum() / ((y == c).sum() + (p == c).sum()) for c in np.unique(y)])


def plain_permutation(keys, x, y, scorer, n_repeats, seed, orders):
    n, width = x.shape
    place = []
    for o in range(orders):
        start = f"{seed}|" if o == 0 else f"{seed}/{o}|"
        place.append(np.argsort([hashlib.md5(f"{start}{k}".encode()).hexdigest() for k in keys]))
    base = macro_f1(y, scorer(x).argmax(axis=1))
    out = {}
    for j in range(width):
        drops = []
        for r in range(n_repeats):
            order, moved = place[r % orders], x.copy()
            step = 1 + (j * n_repeats + r) % (n - 1) if n > 1 else 0
            moved[order, j] = x[np.roll(order, -step), j]
            drops.append(base - macro_f1(y, scorer(moved).argmax(axis=1)))
        out[f"f{j}"] = (np.mean(drops), np.std(drops), base)
    return out


def table_of(spark, n, width=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    x = rng.normal(0, 1, (n, width))
    x[:, 1] += 3 * y
    rows = [(int(i), int(c), v.tolist()) for i, c, v in zip(range(n), y, x, strict=True)]
    cent = np.array([x[y == c].mean(axis=0) if (y == c).any() else np.full(width, np.nan) for c in range(k)])
    return x, y, S.centroid_scorer(cent), spark.createDataFrame(rows, "row_key long, y_true int, features array<double>")


def check(got, want):
    assert {r.feature for r in got} == set(want)
    for r in got:
        assert (r.mean_decrease, r.std_decrease, r.baseline_macro_f1) == pytest.approx(want[r.feature], abs=1e-12)


@pytest.mark.parametrize("n, block, orders", [(1, 7, 1), (2, 7, 2), (6, 7, 3), (7, 7, 1), (8, 7, 3), (40, 7, 1), (61, 7, 2), (61, 50, 3), (61, 1, 1)])
def test_same_as_plain_version(spark, n, block, orders):
    x, y, scorer, df = table_of(spark, n)
    got = I.permutation_importance(df, scorer, 5, 3, seed=9, orders=orders, block=block).collect()
    check(got, plain_permutation(range(n), x, y, scorer, 3, 9, orders))


def test_beyond_one_block_of_the_default_size(spark):
    n = 3 * I.PERMUTED_ROWS + 11
    x, y, scorer, df = table_of(spark, n)
    want = plain_permutation(range(n), x, y, scorer, 2, 42, 2)
    for rows in (df, df.repartition(7)):
        check(I.permutation_importance(rows, scorer, 5, 2, orders=2).collect(), want)


def test_orders_are_bounded_by_repeats(spark):
    *_, scorer, df = table_of(spark, 4)
    with pytest.raises(ValueError):
        I.permutation_importance(df, scorer, 5, 2, orders=3)

"""Shapley attribution of any scorer against a background, inside the tasks.

The value of a coalition S for a row x is the mean score of the background rows with the features of S
taken from x. Features enter one after the other in a random order, and each is credited with the change
it makes; every order is also walked backwards (antithetic), which is exact wherever no more than two
features interact. The credits of one walk add up to the row's score less the background's mean score,
so they do so for any number of orders. Without a number of orders all coalitions are enumerated.

The background is a bounded, seeded sample that travels with the tasks. Rows are scored in blocks of at
most ``SCORED_ROWS`` mixed rows, and only sums for each (feature, class) leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.text import seeded_hash
from flowloom.functions.wavelet import fixed_width_rows
from flowloom.operators.attribution import ranked_attribution
from flowloom.operators.bounds import fetched

BatchScorer = Callable[[np.ndarray], np.ndarray]
#: Mixed rows that are scored at once, and features whose coalitions may be enumerated.
SCORED_ROWS = 16_384
MOST_ENUMERATED = 16
MOST_BACKGROUND = 10_000
SUMS = "pos int, class int, value double, abs_value double, n long"
_ARROW = pa.schema([("pos", pa.int32()), ("class", pa.int32()), ("value", pa.float64()), ("abs_value", pa.float64()), ("n", pa.int64())])


def background_rows(rows: DataFrame, size: int, seed: int = 42, key: str = "row_key", features: str = "features") -> np.ndarray:
    """A seeded sample of ``size`` rows: those with the smallest hashes of their keys."""
    if not 1 <= size <= MOST_BACKGROUND:
        raise ValueError(f"a background has 1 to {MOST_BACKGROUND} rows")
    few = rows.orderBy(seeded_hash(seed, key), key).limit(size).select(F.col(features).cast("array<double>").alias("x"))
    return np.array(fetched(few, "background", size).column("x").to_pylist())


def walks(n_features: int, n_orders: int, seed: int) -> list[np.ndarray]:
    """Random orders of the features, each followed by its reverse."""
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(n_features) for _ in range(n_orders)]
    return [way for order in orders for way in (order, order[::-1])]


def coalition_value(x: np.ndarray, background: np.ndarray, inside: np.ndarray, scorer: BatchScorer) -> np.ndarray:
    """Mean scores [row, class] of the background rows with the features ``inside`` taken from each row."""
    mixed = np.where(inside, x[:, None, :], background[None])
    scores = scorer(mixed.reshape(-1, x.shape[1]))
    return scores.reshape(len(x), len(background), -1).mean(axis=1)


def by_walks(x: np.ndarray, background: np.ndarray, scorer: BatchScorer, orders: list[np.ndarray]) -> np.ndarray:
    """[row, feature, class] values from walks; the ends of a walk are scored once for all."""
    inside = np.zeros(x.shape[1], bool)
    start = np.broadcast_to(scorer(background).mean(axis=0), (len(x), scorer(background[:1]).shape[1]))
    end = scorer(x)
    out = np.zeros((len(x), x.shape[1], start.shape[1]))
    for order in orders:
        inside[:] = False
        last = start
        for step, j in enumerate(order):
            inside[j] = True
            value = end if step + 1 == len(order) else coalition_value(x, background, inside, scorer)
            out[:, j] += value - last
            last = value
    return out / len(orders)


def by_enumeration(x: np.ndarray, background: np.ndarray, scorer: BatchScorer) -> np.ndarray:
    """[row, feature, class] values from all coalitions."""
    width = x.shape[1]
    if width > MOST_ENUMERATED:
        raise ValueError(f"all coalitions of more than {MOST_ENUMERATED} features: give a number of orders")
    members = (np.arange(2**width)[:, None] >> np.arange(width)) & 1 == 1
    values = np.stack([coalition_value(x, background, m, scorer) for m in members])
    sizes = members.sum(axis=1)
    weight = np.array([1 / (width * comb(width - 1, k)) if k < width else 0.0 for k in range(width + 1)])
    out = np.empty((len(x), width, values.shape[2]))
    for j in range(width):
        without = np.flatnonzero(~members[:, j])
        gain = values[without + (1 << j)] - values[without]
        out[:, j] = np.tensordot(weight[sizes[without]], gain, axes=1)
    return out


def shapley_sums(
    rows: DataFrame, scorer: BatchScorer, background: np.ndarray, n_orders: int | None = 8, seed: int = 42, features: str = "features",
) -> DataFrame:
    """(pos, class, value, abs_value, n): sums over all rows of the values and of their magnitudes."""
    width = background.shape[1]
    orders = walks(width, n_orders, seed) if n_orders else None
    at_once = max(1, SCORED_ROWS // len(background))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = size = None
        n = 0
        for batch in batches:
            x = fixed_width_rows(batch.column(0), width) if batch.num_rows else np.zeros((0, width))
            for lo in range(0, len(x), at_once):
                part = x[lo : lo + at_once]
                got = by_walks(part, background, scorer, orders) if orders else by_enumeration(part, background, scorer)
                total = got.sum(axis=0) if total is None else total + got.sum(axis=0)
                size = np.abs(got).sum(axis=0) if size is None else size + np.abs(got).sum(axis=0)
                n += len(part)
        if n:
            pos, cls = (a.ravel().astype(np.int32) for a in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(cls), pa.array(total.ravel()), pa.array(size.ravel()), pa.array(np.full(pos.size, n))], schema=_ARROW)

    parts = rows.select(F.col(features).cast("array<double>").alias("x")).mapInArrow(run, SUMS)
    return parts.groupBy("pos", "class").agg(F.sum("value").alias("value"), F.sum("abs_value").alias("abs_value"), F.sum("n").alias("n"))


def shapley_attribution(
    rows: DataFrame, scorer: BatchScorer, background: np.ndarray, n_orders: int | None = 8, seed: int = 42,
    features: str = "features", names: Sequence[str] | None = None,
) -> DataFrame:
    """(feature, mean_abs, percent, rank): mean over rows of the magnitude of a feature's value, summed over classes."""
    sums = shapley_sums(rows, scorer, background, n_orders, seed, features)
    return ranked_attribution(sums.groupBy("pos").agg(F.sum(F.col("abs_value") / F.col("n")).alias("mean_abs")), names)

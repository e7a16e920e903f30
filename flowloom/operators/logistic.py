"""Multinomial logistic regression by Newton steps over distributed partial sums.

The model has an intercept and a weight per feature for every class but the first. A pass over the rows
gives loss, gradient and curvature: each task adds up its Arrow batches to one row for each model cell,
whose size depends on the model alone, and Spark sums these rows cell by cell. The driver solves one
system of as many unknowns as the model has cells, which is bounded. A step that does not lower the loss
is halved. The penalty is half the squared weights; intercepts are free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.wavelet import fixed_width_rows
from flowloom.operators.bounds import fetched

#: Cells of a model: a task sends, and the driver holds, the square of it in doubles.
MOST_CELLS = 2_048
#: Cells whose rows travel in one Arrow batch.
BATCH_CELLS = 128
_SUMS = pa.schema([("cell", pa.int32()), ("sums", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class LogisticModel:
    """``weights`` is [class, 1 + feature], the intercept first, with zeros for class 0."""

    weights: np.ndarray
    loss: float
    steps: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return probabilities(self.weights, with_one(x))


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x])


def probabilities(weights: np.ndarray, x1: np.ndarray) -> np.ndarray:
    z = x1 @ weights.T
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def partial_sums(weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Curvature [cell, cell], gradient [cell] and loss of some rows."""
    x1 = with_one(x)
    p = probabilities(weights, x1)
    k, d = weights.shape
    hit = y[:, None] == np.arange(k)
    gradient = ((p - hit)[:, 1:].T @ x1).ravel()
    curvature = np.empty(((k - 1) * d, (k - 1) * d))
    for a in range(1, k):
        for b in range(a, k):
            w = p[:, a] * ((a == b) - p[:, b])
            block = (x1 * w[:, None]).T @ x1
            curvature[(a - 1) * d : a * d, (b - 1) * d : b * d] = block
            curvature[(b - 1) * d : b * d, (a - 1) * d : a * d] = block.T
    return curvature, gradient, float(-np.log(np.maximum(p[hit], 1e-300)).sum())


def summed_pass(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Curvature, gradient, loss and number of rows over all of ``rows`` (_y, _x)."""
    k, d = weights.shape
    cells = (k - 1) * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curvature, gradient, loss, n = np.zeros((cells, cells)), np.zeros(cells), 0.0, 0
        for batch in batches:
            if batch.num_rows:
                h, g, one = partial_sums(weights, fixed_width_rows(batch.column(1), d - 1), batch.column(0).to_numpy())
                curvature, gradient, loss, n = curvature + h, gradient + g, loss + one, n + batch.num_rows
        if n:
            # One row for each cell: its curvature and gradient; the last row has the loss and the count.
            table = np.vstack([np.hstack([curvature, gradient[:, None]]), np.r_[loss, n, np.zeros(cells - 1)]])
            for lo in range(0, cells + 1, BATCH_CELLS):
                part = table[lo : lo + BATCH_CELLS]
                offsets = np.arange(0, part.size + 1, cells + 1, dtype=np.int32)
                sums = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), sums], schema=_SUMS)

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(cells + 1)
        for chunk in part["sums"].chunks:
            total += fixed_width_rows(chunk, cells + 1).sum(axis=0)
        return pa.table({"cell": part["cell"].slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))}, schema=_SUMS)

    parts = rows.mapInArrow(run, "cell int, sums array<double>")
    got = fetched(parts.groupBy("cell").applyInArrow(add, "cell int, sums array<double>"), "model cells", cells + 1)
    if not got.num_rows:
        raise ValueError("no rows to fit")
    table = np.empty((cells + 1, cells + 1))
    table[got.column("cell").to_numpy()] = np.array(got.column("sums").to_pylist())
    return table[:-1, :-1], table[:-1, -1], table[-1, 0], int(table[-1, 1])


def fit_logistic(
    train: DataFrame, num_classes: int, width: int, label: str = "y_true", features: str = "features",
    reg: float = 0.01, max_steps: int = 20, tol: float = 1e-9,
) -> LogisticModel:
    """Minimise mean log-loss plus half of ``reg`` times the squared weights.

    Ends where no component of the gradient exceeds ``tol``, or after ``max_steps`` steps. Labels are codes
    from 0; a row with a null label or an infinite value must be filtered out before.
    """
    cells = (num_classes - 1) * (width + 1)
    if num_classes < 2 or cells > MOST_CELLS:
        raise ValueError(f"a model has two classes at least and {MOST_CELLS} cells at most, this one {cells}")
    rows = train.select(F.col(label).cast("int").alias("_y"), F.col(features).cast("array<double>").alias("_x"))
    penalty = np.tile(np.r_[0.0, np.full(width, reg)], num_classes - 1)
    shape = (num_classes - 1, width + 1)

    def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        h, g, loss, n = summed_pass(rows, np.vstack([np.zeros(width + 1), w.reshape(shape)]))
        return h / n + np.diag(penalty), g / n + penalty * w, loss / n + 0.5 * float(penalty @ w**2)

    w = np.zeros(cells)
    h, g, loss = evaluate(w)
    step = 0
    while step < max_steps and np.abs(g).max() > tol:
        move, scale = np.linalg.lstsq(h, g, rcond=None)[0], 1.0
        while True:
            new = w - scale * move
            new_h, new_g, new_loss = evaluate(new)
            if new_loss <= loss + 1e-12 * abs(loss) or scale < 1e-4:
                break
            scale /= 2
        w, h, g, loss, step = new, new_h, new_g, new_loss, step + 1
    return LogisticModel(np.vstack([np.zeros(width + 1), w.reshape(shape)]), loss, step)

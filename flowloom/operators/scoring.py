"""Scorers as Spark jobs: centroid softmax, multinomial logistic regression, batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.wavelet import Geometry, fixed_width_rows, steady_product, transform_matrix
from flowloom.operators.logistic import fit_logistic

BatchScorer = Callable[[np.ndarray], np.ndarray]
MAX_MODEL_CELLS = 50_000_000  # class x position values a model may hold on the driver


def centroid_table(df: DataFrame, label: str, features: str, width: int) -> DataFrame:
    """Mean of every position per class: (class, centroid)."""
    cells = [F.avg(F.get(features, i).cast("double")) for i in range(width)]
    return df.groupBy(F.col(label).cast("int").alias("class")).agg(F.array(*cells).alias("centroid"))


def collect_centroids(table: DataFrame, num_classes: int, width: int) -> np.ndarray:
    """[class, position] means; classes without rows stay NaN and never win."""
    if num_classes * width > MAX_MODEL_CELLS:
        raise ValueError("centroid model is too large to send to the tasks")
    out = np.full((num_classes, width), np.nan)
    for r in table.collect():  # one row per class
        out[r["class"]] = r["centroid"]
    return out


def row_softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - np.nanmax(z, axis=1, keepdims=True))
    e = np.where(np.isnan(e), 0.0, e)
    return e / e.sum(axis=1, keepdims=True)


def centroid_scorer(centroids: np.ndarray) -> BatchScorer:
    """Softmax of minus the squared distance to each class centroid."""

    def score(x: np.ndarray) -> np.ndarray:
        cross = steady_product(x, np.nan_to_num(centroids).T)
        norms = (centroids**2).sum(axis=1)
        return row_softmax(2 * cross - norms)  # |x|^2 is the same for every class

    return score


def subband_centroid_scorer(centroids: np.ndarray, geom: Geometry) -> BatchScorer:
    """The same in subband space: features are transformed, then compared."""
    matrix = transform_matrix(geom)
    inner = centroid_scorer(centroids)
    return lambda x: inner(steady_product(x, matrix))


def score_in_batches(
    df: DataFrame, scorer: BatchScorer, width: int, features: str = "features", pred: str | None = None
) -> DataFrame:
    """Replace ``features`` by y_prob (single precision), one Arrow batch at a time.

    ``features`` may be a flat array or an array of arrays with ``width`` values in all. ``pred`` names a
    column for the best class by the scorer's own precision: rounded to single precision, two classes can be equal.
    """
    kept = [f for f in df.schema.fields if f.name != features]
    names = [f.name for f in kept]
    nested = isinstance(df.schema[features].dataType.elementType, T.ArrayType)
    schema = T.StructType([*kept, T.StructField("y_prob", T.ArrayType(T.FloatType()))])
    if pred:
        schema = schema.add(pred, T.IntegerType())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            col = batch.column(batch.schema.get_field_index(features))
            if nested:
                bands = len(col[0])
                x = fixed_width_rows(col.flatten(), width // bands).reshape(len(col), width)
            else:
                x = fixed_width_rows(col, width)
            scores = scorer(x)
            p = scores.astype(np.float32)
            offsets = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
            probs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.reshape(-1)))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            best = [pa.array(scores.argmax(axis=1).astype(np.int32))] if pred else []
            yield pa.RecordBatch.from_arrays([*cols, probs, *best], names=schema.names)

    return df.mapInArrow(apply, schema)


def fit_score_classifier(
    train: DataFrame, rows: DataFrame, num_classes: int, width: int, label: str = "y_true", features: str = "features",
    max_steps: int = 20, reg: float = 0.01, key: str = "row_key",
) -> DataFrame:
    """Multinomial logistic regression fitted on ``train`` and applied to ``rows``."""
    model = fit_logistic(train, num_classes, width, label, features, reg, max_steps)
    wanted = rows.select(key, F.col(label).cast("int").alias("y_true"), F.col(features).cast("array<double>").alias("_x"))
    return score_in_batches(wanted, model, width, "_x")

"""Stationary wavelet transform along the feature axis of a row.

The transform is linear and the same for every row. Two equivalent forms are given: column
expressions over arrays, and one constant matrix applied to Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.numeric import as_column
from flowloom.functions.vectors import sum_of_squares

# Orthonormal low-pass taps of the Daubechies wavelet with four vanishing moments
# (I. Daubechies, Ten Lectures on Wavelets), and the order in which subbands are stored.
DB4_LOW = (
    -0.010597401785069032,
    0.0328830116668852,
    0.030841381835560764,
    -0.18703481171909309,
    -0.027983769416859854,
    0.6308807679298589,
    0.7148465705529157,
    0.2303778133088965,
)
SUBBANDS = ("cD1", "cD2", "cD3", "cA3")

# Quadrature mirror of the low-pass taps.
DB4_HIGH = tuple((-1) ** (m + 1) * DB4_LOW[7 - m] for m in range(8))


@dataclass(frozen=True)
class Geometry:
    """Lengths that tie a feature count to its padded sequence and square image."""

    n_features: int
    n_padded: int
    side: int
    level: int
    raised_from: int | None
    final_side: int

    @property
    def image_pad(self) -> int:
        return self.side**2 - self.n_padded

    def flat_dim(self, channels: int = 32) -> int:
        return channels * self.final_side**2


def side_after_pooling(side: int, n_pools: int, ceil_mode: bool = True) -> int:
    """Side of a square map after ``n_pools`` halvings."""
    step = 2**n_pools
    return -(-side // step) if ceil_mode else side // step


def geometry(
    n_features: int,
    level: int = 3,
    min_side: int = 8,
    force_side: int | None = None,
    n_pools: int = 3,
    ceil_mode: bool = True,
    min_final: int = 2,
) -> Geometry:
    """Padded length and image side; the side is raised until pooling leaves enough of it."""
    if n_features < 1 or level < 1:
        raise ValueError("n_features and level must be at least 1")
    unit = 2**level
    padded = -(-n_features // unit) * unit
    if force_side is None:
        wanted = max(min_side, math.isqrt(padded - 1) + 1)
        # smallest side whose pooled map still has min_final cells per edge
        unpooled = (min_final - 1) * 2**n_pools + 1 if ceil_mode else min_final * 2**n_pools
        side = max(wanted, unpooled)
        raised = wanted if side > wanted else None
    else:
        side, raised = force_side, None
    final = side_after_pooling(side, n_pools, ceil_mode)
    if side * side < padded:
        raise ValueError(f"side {side} cannot hold {padded} positions")
    if final < min_final:
        raise ValueError(f"side {side} leaves a {final}x{final} map, need {min_final}")
    return Geometry(n_features, padded, side, level, raised, final)


def reflect_positions(n_features: int, n_padded: int) -> list[int]:
    """Source position of every padded position; the edge itself is not repeated."""
    if n_features == 1:
        return [0] * n_padded
    period = 2 * (n_features - 1)
    return [min(i % period, period - i % period) for i in range(n_padded)]


def pad_reflect(features: Column | str, geom: Geometry) -> Column:
    x = as_column(features)
    tail = reflect_positions(geom.n_features, geom.n_padded)[geom.n_features :]
    if not tail:
        return x
    return F.concat(x, F.array(*[F.element_at(x, p + 1) for p in tail]))


def _filter_step(x: Column, taps: tuple[float, ...], step: int, n: int) -> Column:
    """Periodic convolution with taps spread ``step`` apart."""

    def at(o: Column) -> Column:
        terms = [
            F.lit(h) * F.get(x, F.pmod(o + F.lit(step * (4 - m)), F.lit(n)).cast("int"))
            for m, h in enumerate(taps)
        ]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def with_subbands_sql(df: DataFrame, features: str, geom: Geometry, out: str = "subbands") -> DataFrame:
    """Array-expression form, one projection per level; no Python worker is involved."""
    cur = df.withColumn(
        "_a0", F.transform(pad_reflect(features, geom), lambda v: v.cast("double"))
    )
    for lev in range(1, geom.level + 1):
        step, prev = 2 ** (lev - 1), F.col(f"_a{lev - 1}")
        cur = cur.select(
            "*",
            _filter_step(prev, DB4_HIGH, step, geom.n_padded).alias(f"_d{lev}"),
            _filter_step(prev, DB4_LOW, step, geom.n_padded).alias(f"_a{lev}"),
        )
    bands = [F.col(f"_d{lev}") for lev in range(1, geom.level + 1)] + [F.col(f"_a{geom.level}")]
    extra = [f"_a{i}" for i in range(geom.level + 1)] + [f"_d{i}" for i in range(1, geom.level + 1)]
    return cur.withColumn(out, F.array(*bands)).drop(*extra)


def transform_matrix(geom: Geometry) -> np.ndarray:
    """[n_features, (level + 1) * n_padded] matrix of padding and all filter steps."""
    n = geom.n_padded
    pad = np.zeros((geom.n_features, n))
    pad[reflect_positions(geom.n_features, n), np.arange(n)] = 1.0
    approx, bands = pad, []
    for lev in range(1, geom.level + 1):
        step = 2 ** (lev - 1)
        low = sum(h * np.roll(approx, -step * (4 - m), axis=1) for m, h in enumerate(DB4_LOW))
        high = sum(h * np.roll(approx, -step * (4 - m), axis=1) for m, h in enumerate(DB4_HIGH))
        bands.append(high)
        approx = low
    return np.hstack([*bands, approx])


def fixed_width_rows(column: pa.Array, width: int) -> np.ndarray:
    """[rows, width] view of an Arrow list column whose lists all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size != len(column) * width:
        raise ValueError(f"expected lists of length {width}")
    return flat.reshape(len(column), width).astype(np.float64, copy=False)


#: Rows of one product. A product adds up in an order that depends on its height, so all have the same.
BLOCK_ROWS = 256


def steady_product(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``x @ matrix`` in blocks of one height, the last filled with zeros: a row's result depends on that row alone."""
    out = np.empty((len(x), matrix.shape[1]))
    for lo in range(0, len(x), BLOCK_ROWS):
        block = x[lo : lo + BLOCK_ROWS]
        if len(block) < BLOCK_ROWS:
            block = np.vstack([block, np.zeros((BLOCK_ROWS - len(block), x.shape[1]))])
        out[lo : lo + BLOCK_ROWS] = (np.ascontiguousarray(block) @ matrix)[: len(x) - lo]
    return out


def with_subbands(df: DataFrame, features: str, geom: Geometry, out: str = "subbands") -> DataFrame:
    """Matrix form: products over Arrow batches, rows stay in their partition."""
    kept = [f for f in df.schema.fields if f.name != features]
    keep_names = [f.name for f in kept]
    n, bands = geom.n_padded, geom.level + 1
    schema = T.StructType(
        [*kept, T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))]
    )
    matrix = transform_matrix(geom)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            x = fixed_width_rows(batch.column(batch.schema.get_field_index(features)), geom.n_features)
            flat = pa.array(steady_product(x, matrix).reshape(-1))
            inner = pa.ListArray.from_arrays(
                pa.array(np.arange(0, rows * bands * n + 1, n, dtype=np.int32)), flat
            )
            outer = pa.ListArray.from_arrays(
                pa.array(np.arange(0, rows * bands + 1, bands, dtype=np.int32)), inner
            )
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep_names]
            yield pa.RecordBatch.from_arrays([*cols, outer], names=[*keep_names, out])

    return df.mapInArrow(apply, schema)


def subband_image(subbands: Column | str, geom: Geometry) -> Column:
    """Each band padded with zeros to side x side and cut into image rows."""
    s, pad = geom.side, geom.image_pad
    filler = F.array_repeat(F.lit(0.0), pad)

    def one(band: Column) -> Column:
        cells = F.transform(F.concat(band, filler), lambda v: v.cast("float"))
        return F.transform(
            F.sequence(F.lit(0), F.lit(s - 1)), lambda r: F.slice(cells, r * s + 1, F.lit(s))
        )

    return F.transform(as_column(subbands), one)


def swt_images(df: DataFrame, features: str, geom: Geometry, out: str = "image") -> DataFrame:
    """Padding, transform and image in one go."""
    return (
        with_subbands(df, features, geom, "_bands")
        .withColumn(out, subband_image("_bands", geom))
        .drop("_bands")
    )


def subband_energy(subbands: Column | str) -> Column:
    """Sum of squared coefficients per band."""
    return F.transform(as_column(subbands), sum_of_squares)


def band_positions(df: DataFrame, subbands: str, geom: Geometry, *keep: str) -> DataFrame:
    """One row per real feature position with a column per band; padding positions are dropped."""
    zipped = F.arrays_zip(*[F.get(F.col(subbands), i).alias(b) for i, b in enumerate(SUBBANDS)])
    cols = [F.col("_z")[b].alias(b) for b in SUBBANDS]
    return (
        df.select(*keep, F.posexplode(zipped).alias("pos", "_z"))
        .filter(F.col("pos") < geom.n_features)
        .select(*keep, "pos", *cols)
    )


def energy_by_class(df: DataFrame, subbands: str, label: str, classes: DataFrame) -> DataFrame:
    """Mean energy per class and band; a class without rows gets zeros.

    ``classes`` holds one row per class under the name of ``label``.
    """
    energy = subband_energy(subbands)
    means = df.select(label, energy.alias("_e")).groupBy(label).agg(
        *[F.avg(F.get("_e", i)).alias(b) for i, b in enumerate(SUBBANDS)]
    )
    return classes.select(label).join(means, label, "left").fillna(0.0, subset=list(SUBBANDS))


def energy_share(energy: DataFrame) -> DataFrame:
    """Energy of each band as a share of its row; all-zero rows stay zero."""
    total = sum((F.col(b) for b in SUBBANDS[1:]), F.col(SUBBANDS[0]))
    return energy.withColumns(
        {b: F.when(total > 0, F.col(b) / total).otherwise(F.lit(0.0)) for b in SUBBANDS}
    )

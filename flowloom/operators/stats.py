"""Train-only column statistics, column selection and scaling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.numeric import finite_or_null
from flowloom.functions.wavelet import fixed_width_rows
from flowloom.operators.sampling import plain_sample

STAT_SCHEMA = (
    "ordinal int, column string, n_rows long, n_finite long, n_missing long, total double, "
    "min double, max double"
)


def as_matrix(columns: Sequence[str]) -> Column:
    """The columns as one array of doubles.

    Spark cuts the code of a long array into methods that the JVM compiles; the code of a projection of
    some forty columns or more is one method that is too large for that, so every row would be interpreted.
    """
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def fingerprints(values: np.ndarray, finite: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[column] sums, modulo 2^64, of a row's weight times its folded value; every missing value is one value."""
    bits = np.where(finite, values + 0.0, np.nan).view(np.uint64)
    return ((bits ^ (bits >> np.uint64(32))) * weights).sum(axis=1, dtype=np.uint64)


def column_stats(
    df: DataFrame, features: Sequence[str], split: str | None = "split", part: str = "train", key: str | None = None,
    matrix: str | None = None,
) -> DataFrame:
    """One row per feature over the train rows: counts, sum, min and max of finite values.

    One scan whatever the number of columns: each task adds up its Arrow batches and sends one row
    per column. Features of a table without rows have zero counts. With a ``key`` there is also a
    ``fingerprint`` of the values by key, the same for any order of the rows: columns whose fingerprints
    differ are not equal, and no scan is needed to find that out. ``matrix`` names an array that holds the
    features already.
    """
    rows = df.filter(F.col(split) == part) if split else df
    width = len(features)
    weight = (F.xxhash64(F.col(f"`{key}`")) if key else F.lit(0).cast("long")).alias("w")
    slim = rows.select(weight, (F.col(matrix) if matrix else as_matrix(features)).alias("x"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, finite, total, print_ = 0, np.zeros(width, np.int64), np.zeros(width), np.zeros(width, np.uint64)
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            n += batch.num_rows
            x = np.ascontiguousarray(fixed_width_rows(batch.column(1), width).T)
            ok = np.isfinite(x)
            finite += ok.sum(axis=1)
            if key:
                print_ += fingerprints(x, ok, batch.column(0).to_numpy().view(np.uint64))
            whole = ok.all()
            total += (x if whole else np.where(ok, x, 0.0)).sum(axis=1)
            low = np.minimum(low, (x if whole else np.where(ok, x, np.inf)).min(axis=1))
            high = np.maximum(high, (x if whole else np.where(ok, x, -np.inf)).max(axis=1))
        if n:
            halves = (print_ >> np.uint64(32)).astype(np.int64), (print_ & np.uint64(2**32 - 1)).astype(np.int64)
            cols = (np.arange(width, dtype=np.int32), np.full(width, n), finite, total, low, high, *halves)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["ordinal", "n", "k", "s", "lo", "hi", "p1", "p0"])

    parts = slim.mapInArrow(add_up, "ordinal int, n long, k long, s double, lo double, hi double, p1 long, p0 long")
    sums = parts.groupBy("ordinal").agg(*[f(c).alias(c) for c, f in (("n", F.sum), ("k", F.sum), ("s", F.sum), ("lo", F.min), ("hi", F.max), ("p1", F.sum), ("p0", F.sum))])
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "ordinal int, column string")
    zero, half = F.lit(0).cast("long"), F.lit(2**32)
    n, k = F.coalesce("n", zero), F.coalesce("k", zero)
    # The sums of halves stay far below the range of a long; their carry is taken over here.
    print_ = F.concat_ws(":", (F.col("p1") + F.floor(F.col("p0") / half)) % half, F.col("p0") % half).alias("fingerprint")
    # both sides have one row per column
    return names.join(F.broadcast(sums), "ordinal", "left").select(
        "ordinal", "column", n.alias("n_rows"), k.alias("n_finite"), (n - k).alias("n_missing"),
        F.coalesce("s", F.lit(0.0)).alias("total"), F.when(k > 0, F.col("lo")).alias("min"), F.when(k > 0, F.col("hi")).alias("max"),
        *([print_] if key else []),
    )


def scaler_stats(stats: DataFrame) -> DataFrame:
    """Mean, bounds, missing ratio and constancy; columns without a finite value get zeros."""
    n_rows = F.greatest(F.col("n_rows"), F.lit(1))
    lo, hi = F.coalesce("min", F.lit(0.0)), F.coalesce("max", F.lit(0.0))
    mean = F.when(F.col("n_finite") > 0, F.col("total") / F.greatest(F.col("n_finite"), F.lit(1)))
    return stats.select(
        "ordinal",
        "column",
        "n_rows",
        "n_finite",
        "n_missing",
        lo.alias("min"),
        hi.alias("max"),
        F.coalesce(mean, F.lit(0.0)).alias("mean"),
        (1 - F.col("n_finite") / n_rows).alias("missing_ratio"),
        (hi - lo <= 0).alias("is_constant"),
        *[c for c in stats.columns if c == "fingerprint"],
    )


# ------------------------------------------------------------------ selection
# The three reasons of dropped columns, in the order in which they are checked.
MISSING, CONSTANT, DUPLICATE = "missing_ratio_above_threshold", "constant_on_train", "duplicate_of"


def _drop_row(df: DataFrame, reason: str, evidence: Column, rank: int) -> DataFrame:
    return df.select(
        F.lit(rank).alias("step"), "ordinal", "column", F.lit(reason).alias("reason"), evidence.alias("evidence")
    )


def drop_high_missing(scaler: DataFrame, threshold: float = 0.80) -> DataFrame:
    hit = scaler.filter(F.col("missing_ratio") > threshold)
    return _drop_row(hit, MISSING, F.round("missing_ratio", 6).cast("string"), 1)


def drop_constant(scaler: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Constant columns among those not already dropped for missing values."""
    hit = scaler.filter((F.col("missing_ratio") <= threshold) & F.col("is_constant"))
    return _drop_row(hit, CONSTANT, F.round("min", 6).cast("string"), 2)


def duplicate_candidates(scaler: DataFrame, threshold: float = 0.80, constants: bool = True) -> DataFrame:
    """Kept columns whose statistics, and fingerprints if there are any, equal those of an earlier column: (ordinal, column, keeper)."""
    kept = scaler.filter(F.col("missing_ratio") <= threshold)
    if constants:
        kept = kept.filter(~F.col("is_constant"))
    # nine digits of the mean: sums of equal columns from different aggregates may differ in the last bits
    mean = F.format_string("%.8e", F.col("mean"))
    signature = [F.round("min", 9), F.round("max", 9), mean, F.col("n_missing"), *[F.col(c) for c in scaler.columns if c == "fingerprint"]]
    same = Window.partitionBy(*signature).orderBy("ordinal")
    return kept.select(
        "ordinal",
        "column",
        F.first("column").over(same).alias("keeper"),
        F.row_number().over(same).alias("_i"),
    ).filter(F.col("_i") > 1).drop("_i")


def drop_duplicate_columns(
    rows: DataFrame, candidates: DataFrame, verify_rows: int | None = None, key: str | None = None, seed: int = 42
) -> DataFrame:
    """Candidates equal to their keeper on every given row, checked in one aggregate.

    ``rows`` are the train rows; with ``verify_rows`` only that many of them, drawn by the hash of ``key``, are
    compared. The candidate list is bounded by the number of columns and is read by the driver.
    """
    if verify_rows is not None and (key is None or verify_rows < 1):
        raise ValueError("a comparison on drawn rows needs their number and the row key")
    pairs = candidates.collect()  # fewer rows than the table has columns
    if pairs and verify_rows is not None:
        rows = plain_sample(rows, key, verify_rows, seed)
    spark = rows.sparkSession
    schema = "ordinal int, column string, keeper string, n_diff long, n_rows long"
    if not pairs:
        found = spark.createDataFrame([], schema)
    else:
        diffs = [
            F.count(
                F.when(~finite_or_null(F.col(f"`{p.keeper}`")).eqNullSafe(finite_or_null(F.col(f"`{p.column}`"))), 1)
            ).alias(f"d{i}")
            for i, p in enumerate(pairs)
        ]
        structs = [
            F.struct(
                F.lit(p.ordinal).alias("ordinal"),
                F.lit(p.column).alias("column"),
                F.lit(p.keeper).alias("keeper"),
                F.col(f"d{i}").alias("n_diff"),
                F.col("n").alias("n_rows"),
            )
            for i, p in enumerate(pairs)
        ]
        found = rows.agg(F.count(F.lit(1)).alias("n"), *diffs).select(F.inline(F.array(*structs)))
    hit = found.filter((F.col("n_diff") == 0) & (F.col("n_rows") > 0))
    return _drop_row(hit, DUPLICATE, F.col("keeper"), 3)


def column_drop_report(
    scaler: DataFrame, train_rows: DataFrame, threshold: float = 0.80,
    constants: bool = True, duplicates: bool = True, verify_rows: int | None = None, key: str | None = None, seed: int = 42,
) -> DataFrame:
    """Dropped columns in the order missing, constant, duplicate: (step, ordinal, column, reason, evidence)."""
    report = drop_high_missing(scaler, threshold)
    if constants:
        report = report.unionByName(drop_constant(scaler, threshold))
    if duplicates:
        cand = duplicate_candidates(scaler, threshold, constants)
        report = report.unionByName(drop_duplicate_columns(train_rows, cand, verify_rows, key, seed))
    return report


def subset_stats(scaler: DataFrame, drops: DataFrame) -> DataFrame:
    """Statistics of the kept columns; nothing is fitted again."""
    return scaler.join(drops.select("column"), "column", "left_anti")


# ------------------------------------------------------------------ scaling
@dataclass(frozen=True)
class Scaler:
    """Collected statistics of the kept columns, in feature order."""

    columns: tuple[str, ...]
    minimum: tuple[float, ...]
    maximum: tuple[float, ...]
    mean: tuple[float, ...]

    @classmethod
    def collect(cls, scaler: DataFrame) -> Scaler:
        """Reads one row per feature."""
        rows = scaler.select("ordinal", "column", "min", "max", "mean").orderBy("ordinal").collect()
        if not rows:
            raise ValueError("no feature columns left")
        return cls(
            tuple(r["column"] for r in rows),
            tuple(r["min"] for r in rows),
            tuple(r["max"] for r in rows),
            tuple(r["mean"] for r in rows),
        )

    def imputed(self, i: int) -> Column:
        return F.coalesce(finite_or_null(F.col(f"`{self.columns[i]}`")), F.lit(self.mean[i]))

    def scaled(self, i: int) -> Column:
        span = self.maximum[i] - self.minimum[i]
        x = (self.imputed(i) - F.lit(self.minimum[i])) / F.lit(span if span > 0 else 1.0)
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).cast("float")


def unfused(column: Column) -> Column:
    """The column through a lambda over one element.

    A projection that holds a lambda is not fused with its neighbours, and Spark then cuts its code
    into methods that the JVM can compile. Fused, the code of some twenty columns is one method too
    large for the compiler, and every row is interpreted.
    """
    return F.element_at(F.transform(F.array(column), lambda x: x), 1)


def _each(scaler: Scaler, form: Callable[[int], Column]) -> dict[str, Column]:
    return {c: unfused(form(i)) if i == 0 else form(i) for i, c in enumerate(scaler.columns)}


def impute_mean(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Missing values replaced by the train mean."""
    return df.withColumns(_each(scaler, scaler.imputed))


def minmax_scale(df: DataFrame, scaler: Scaler, matrix: str | None = None, features: Sequence[str] = ()) -> DataFrame:
    """Impute, scale by the train bounds, clip to [0, 1], single precision.

    The features of an Arrow batch are scaled as one matrix; the other columns pass as they are. With
    ``matrix``, an array that holds ``features`` in this order, the scaled columns follow the others.
    """
    kept = scaler.columns
    given = list(features) if matrix else list(kept)
    rest = [f for f in df.schema.fields if f.name not in ({matrix} if matrix else set(kept))]
    source = df.select(*[F.col(f"`{f.name}`") for f in rest], (F.col(matrix) if matrix else as_matrix(kept)).alias("_x"))
    take = [given.index(c) for c in kept]
    whole = take == list(range(len(given)))
    names = [f.name for f in rest] + list(kept) if matrix else df.columns
    other = {f.name: (f, i) for i, f in enumerate(rest)}
    # The rows leave as they should be: a projection of this width on top would be interpreted.
    out = T.StructType([other[c][0] if c in other else T.StructField(c, T.FloatType()) for c in names])
    place = {c: i for i, c in enumerate(kept)}
    minimum, mean = np.array(scaler.minimum), np.array(scaler.mean)
    span = np.array(scaler.maximum) - minimum
    span = np.where(span > 0, span, 1.0)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = fixed_width_rows(batch.column(len(rest)), len(given))
            x = x if whole else x[:, take]
            x = (np.where(np.isfinite(x), x, mean) - minimum) / span
            columns = np.ascontiguousarray(np.clip(x, 0.0, 1.0).astype(np.float32).T)
            yield pa.RecordBatch.from_arrays([batch.column(other[c][1]) if c in other else pa.array(columns[place[c]]) for c in names], names=list(names))

    return source.mapInArrow(scale, out)


def assemble_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Ordered features as one array column, the scalars dropped."""
    vector = F.array(*[F.col(f"`{c}`") for c in columns])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in set(columns)]
    return df.select(*rest, vector.alias(out))

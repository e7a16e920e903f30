"""Scalar column functions: missing values, rounding, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True only for a number that is neither NULL, NaN nor infinite."""
    x = as_column(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def finite_or_null(c: Column | str) -> Column:
    """NULL becomes the only missing value, so aggregates skip it."""
    x = as_column(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(INF)), x)


def r6(c: Column | str) -> Column:
    """Six decimals, non-finite as NULL: the number format of every report."""
    return F.round(finite_or_null(c), 6)


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den as double, ``empty`` where the denominator is not positive."""
    d = den.cast("double")
    return F.when(d > 0, num.cast("double") / d).otherwise(F.lit(empty).cast("double"))


def benign_vs_attack(code: Column | str, benign_code: int) -> Column:
    """0 for the benign class, 1 for every other one."""
    return (as_column(code) != F.lit(benign_code)).cast("int")

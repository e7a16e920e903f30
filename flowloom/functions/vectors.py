"""Array functions on probability and feature vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.numeric import as_column


def argmax_class(p: Column | str) -> Column:
    """0-based index of the largest entry, the first one on ties."""
    v = as_column(p)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row.

    An expression used inside a lambda would otherwise be evaluated for every array element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def softmax(z: Column | str) -> Column:
    """Softmax of a logit array, shifted by its maximum."""

    def share(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.transform(e, lambda x: x / t))

    def shifted(v: Column) -> Column:
        return let(F.array_max(v), lambda m: let(F.transform(v, lambda x: F.exp(x - m)), share))

    return let(F.transform(as_column(z), lambda x: x.cast("double")), shifted)


def prob_of(p: Column | str, code: Column | str) -> Column:
    return F.element_at(as_column(p), as_column(code).cast("int") + 1).cast("double")


def squared_error(p: Column | str, code: Column | str) -> Column:
    """Sum over classes of (p - one_hot)^2, from sum p^2 - 2 p[y] + 1."""
    v = as_column(p)
    sum_sq = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return sum_sq - 2 * prob_of(p, code) + 1


def sum_of_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))

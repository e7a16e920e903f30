"""Size checks that travel with the plan, for tables that are broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CLASSES = 32_767  # labels are stored as 16-bit codes


def bounded(df: DataFrame, max_rows: int, what: str) -> DataFrame:
    """``df`` unchanged if it has at most ``max_rows`` rows, otherwise the query fails.

    At most ``max_rows + 1`` rows ever reach the one task that counts them.
    """
    message = F.lit(f"{what}: more than {max_rows} rows")
    position = F.row_number().over(Window.orderBy(F.lit(1)))
    return (
        df.limit(max_rows + 1)
        .withColumn("_pos", position)
        .filter(
            F.when(F.col("_pos") > max_rows, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        )
        .drop("_pos")
    )


def fetched(df: DataFrame, what: str, max_rows: int = MAX_CLASSES) -> pa.Table:
    """Rows of a small fitted table; more than ``max_rows`` is an error."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return table


def labelled(df: DataFrame, label: str, name: str | None = None) -> DataFrame:
    """``df`` unchanged if every label is there; a NULL label fails the query.

    A row without a label belongs to no class: codes, draws and splits per class would shift or lose it.
    """
    missing = F.raise_error(F.lit(f"NULL in label column {name or label}")).cast("boolean")
    return df.filter(F.when(F.col(f"`{label}`").isNull(), missing).otherwise(F.lit(True)))


def pinned(df: DataFrame, what: str, max_rows: int = MAX_CLASSES) -> DataFrame:
    """A small fitted table, computed once and held as a constant of later plans.

    Without it every plan that uses the table would repeat the scans behind it.
    """
    return df.sparkSession.createDataFrame(fetched(df, what, max_rows), schema=df.schema)


def side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row tables with different columns as one row, without a join."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def small(df: DataFrame, what: str, max_rows: int = MAX_CLASSES) -> DataFrame:
    """Broadcast side with its bound enforced."""
    return F.broadcast(bounded(df, max_rows, what))

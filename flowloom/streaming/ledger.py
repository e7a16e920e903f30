"""Append-once on a stream, for ever: state of one row per key, repeats reported on a side output.

Rows pass two keyed stages. The first is keyed by (key, salt), so that a key that a third of all rows
hold is spread over ``SALTS`` groups; it lets one row of each group through, ever, and marks the others as
repeats. The second is keyed by the key alone and sees at most one row of each salt; repeats pass it
under their own (key, salt) without state. Both keep state without a time limit, so a repeat is found
however late it comes. Of the rows of one micro-batch the one with the smallest order wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowloom.session import shared_dir

#: Groups over which the rows of one key are spread before they meet.
SALTS = 64
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstEver(StatefulProcessor):
    """Marks the first row of a group, over all batches, and every other one; rows marked before stay as they are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", T.StructType([T.StructField("yes", T.BooleanType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best: pd.DataFrame | None = None
        open_ = True
        for pdf in rows:
            if pdf["repeat"].iloc[0]:
                # A group holds either repeats or rows that are still open.
                yield pdf
                continue
            if best is None and open_:
                open_ = not self.taken.exists()
            at = pdf["rank"].to_numpy().argmin()
            if open_ and (best is None or pdf["rank"].iloc[at] < best["rank"].iloc[0]):
                lost, best = best, pdf.iloc[[at]]
                pdf = pdf.drop(pdf.index[at])
                pdf = pdf if lost is None else pd.concat([pdf, lost])
            yield pdf.assign(repeat=True)
        if best is not None:
            self.taken.update((True,))
            yield best

    def close(self) -> None:
        pass


def append_once(rows: DataFrame, key: str, order: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with ``accepted``: true for the first row of each key over the whole life of the stream.

    ``order`` is a whole number that tells rows of one key apart; it decides within a micro-batch.
    """
    # Names that are no Python names do not reach a stateful operator, so columns travel under plain ones.
    own = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    salt = F.pmod(F.xxhash64(f"`{order}`"), F.lit(salts)).cast("int")
    marked = rows.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()], F.col(f"`{order}`").cast("long").alias("rank"), salt.alias("salt"), F.lit(False).alias("repeat"))

    def stage(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).transformWithStateInPandas(FirstEver(), df.schema, "append", "none")

    salted = stage(marked, own[key], "salt")
    # Only rows that are still open meet under the key; the others stay in the group they come from.
    place = F.when(F.col("repeat"), F.col("salt")).otherwise(F.lit(-1))
    met = stage(salted.withColumn("place", place), own[key], "place")
    return met.select(*[F.col(o).alias(c) for c, o in own.items()], (~F.col("repeat")).alias("accepted"))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in a store that such operators need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def run_ledger(rows: DataFrame, key: str, order: str, base: str | None = None, salts: int = SALTS) -> DataFrame:
    """Take in all that is available and give back every row so far with its verdict.

    Offsets, state and rows live below ``base`` in the shared folder; called again with the same
    ``base``, it goes on where it ended. Accepted rows and repeats are partitions of one table.
    """
    spark = rows.sparkSession
    base = base or shared_dir(spark, "ledger")
    verdicts = append_once(rows, key, order, salts)
    with keyed_state(spark):
        query = (
            verdicts.writeStream.format("parquet").partitionBy("accepted").option("path", f"{base}/table")
            .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(verdicts.schema).parquet(f"{base}/table")

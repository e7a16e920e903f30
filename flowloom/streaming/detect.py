"""Structured Streaming forms of the counter detector, the confusion matrix and the history check."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.anomaly import Thresholds, counter_features, sigma_detect, windowed_counters
from flowloom.session import shared_dir


def file_stream(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of a batch read.

    Where ``pattern`` names no file but a table that is a folder of parts, all its parts are streamed.
    """
    stream = spark.readStream.option("pathGlobFilter", pattern)
    try:
        schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        path = f"{path.rstrip('/')}/{pattern}"
        schema, stream = spark.read.parquet(path).schema, spark.readStream
    return stream.schema(schema).parquet(path)


def run_to_table(stream: DataFrame, purpose: str) -> DataFrame:
    """Append everything available to a Parquet table in the shared folder and read it back.

    Offsets, state and results live in that folder, so a lost executor or a restart repeats
    nothing and loses nothing.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def stream_detect(
    events: DataFrame, thresholds: Thresholds, switch: str, ts: str, kind: str, value: str,
    length: str = "1 day", delay: str = "1 hour",
) -> DataFrame:
    """Counters per closed window with the three-sigma verdict.

    Events older than the watermark are dropped; a window appears once the watermark has passed
    its end. Thresholds come from a batch fit and are constants of the plan.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counters = windowed_counters(timed, switch, ts, kind, value, length)
    return sigma_detect(counter_features(counters), thresholds)


def stream_confusion(preds: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Running (y_true, y_pred, n); to be written in complete mode."""
    return preds.groupBy(
        F.col(true).cast("int").alias("y_true"), F.col(pred).cast("int").alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def run_complete(stream: DataFrame) -> DataFrame:
    """Last snapshot of a complete-mode aggregate, written batch by batch to the shared folder."""
    spark = stream.sparkSession
    base = shared_dir(spark, "snapshot")
    written: list[str] = []

    def keep(snapshot: DataFrame, batch: int) -> None:
        path = f"{base}/table/{batch}"
        snapshot.write.mode("overwrite").parquet(path)  # a batch that is run again writes the same folder
        written.append(path)

    query = (
        stream.writeStream.foreachBatch(keep).outputMode("complete")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(written[-1]) if written else spark.createDataFrame([], stream.schema)


def stream_append_unique(
    rows: DataFrame, epoch: str, ts: str, spread_by: str, delay: str = "2 days", salts: int = 64
) -> DataFrame:
    """First row per epoch within the watermark delay.

    Rows are first made unique per (epoch, salt), so an epoch that repeats very often is spread
    over many tasks before the final check by epoch.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).alias("_salt")
    return (
        rows.select("*", salt)
        .withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark([epoch, "_salt"])
        .dropDuplicatesWithinWatermark([epoch])
        .drop("_salt")
    )

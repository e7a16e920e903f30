"""Thresholds learned inside the stream: mergeable moments, one snapshot for each micro-batch.

The state of a feature is (count, mean, sum of squared deviations). A micro-batch adds its own state
from partial sums; states merge exactly, in any order and any split, so the thresholds after any
number of batches are those of one pass over all rows. Every batch writes its snapshot and its verdicts
under its own number: a batch that is run again overwrites what it wrote, from the same predecessor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.anomaly import SIGMAS, Thresholds, all_finite, sigma_detect
from flowloom.session import shared_dir

FEATURES = ("r_pi", "r_fi", "d_np")
STATE = "feature string, n long, mean double, m2 double"


def moments(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, n, mean, m2) over rows in which all features are finite: one row for each feature."""
    fin = all_finite(*features)
    aggs = []
    for c in features:
        x = F.when(fin, F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"{c}_n"), F.avg(x).alias(f"{c}_mean"), F.var_pop(x).alias(f"{c}_var")]
    one = [
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}_n").alias("n"), F.coalesce(f"{c}_mean", F.lit(0.0)).alias("mean"),
                 F.coalesce(F.col(f"{c}_var") * F.col(f"{c}_n"), F.lit(0.0)).alias("m2"))
        for c in features
    ]
    return rows.agg(*aggs).select(F.inline(F.array(*one)))


def merged(states: DataFrame) -> DataFrame:
    """One state for each feature out of any number of them; squared distances of the means are added, nothing cancels."""
    total = states.groupBy("feature").agg(F.sum("n").alias("_n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"))
    apart = F.col("n") * F.coalesce(F.col("mean") - F.col("_mean"), F.lit(0.0)) ** 2
    return states.join(F.broadcast(total), "feature").groupBy("feature").agg(
        F.max("_n").alias("n"), F.coalesce(F.max("_mean"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.sum(F.col("m2") + apart), F.lit(0.0)).alias("m2"),
    )


def thresholds_of(state: DataFrame, k: float = SIGMAS) -> Thresholds:
    """Means less (for packets: plus) k deviations, from one state for each of the three features."""
    by = {r["feature"]: r for r in state.collect()}  # three rows
    edge = {c: by[c]["mean"] + (k if c == "d_np" else -k) * (by[c]["m2"] / max(1, by[c]["n"])) ** 0.5 for c in FEATURES}
    return Thresholds(edge["r_pi"], edge["r_fi"], edge["d_np"], by["r_pi"]["n"])


class Snapshots:
    """States by version in the shared folder; a version is complete once its success mark stands."""

    def __init__(self, spark: SparkSession, base: str | None = None):
        self.spark, self.base = spark, base or shared_dir(spark, "thresholds")

    def path(self, version: int) -> str:
        return f"{self.base}/states/version={version}"

    def versions(self) -> list[int]:
        """Complete versions, ascending. There is one for each batch; a listing, no data."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/states")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(mark(p, "_SUCCESS")))

    def at(self, version: int) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(self.path(version))

    def before(self, version: int) -> DataFrame | None:
        """The last state below ``version``."""
        earlier = [v for v in self.versions() if v < version]
        return self.at(earlier[-1]) if earlier else None

    def latest(self) -> DataFrame | None:
        found = self.versions()
        return self.at(found[-1]) if found else None

    def add(self, version: int, delta: DataFrame) -> DataFrame:
        last = self.before(version)
        state = merged(delta if last is None else last.unionByName(delta))
        state.coalesce(1).write.mode("overwrite").parquet(self.path(version))
        return self.at(version)


def learn_and_detect(
    features: DataFrame, normal: Column, base: str | None = None, k: float = SIGMAS,
) -> tuple[Snapshots, DataFrame]:
    """Learn from the ``normal`` rows of each micro-batch, then judge all of its rows.

    Gives the snapshots and the rows with ``suspicious`` and the ``version`` that judged them. A batch is
    judged by the state with its own normal rows in it; before the first normal row nothing is suspicious.
    """
    spark = features.sparkSession
    snapshots = Snapshots(spark, base)
    judged = f"{snapshots.base}/verdicts"

    def take(batch: DataFrame, version: int) -> None:
        th = thresholds_of(snapshots.add(version, moments(batch.where(normal))), k)
        out = sigma_detect(batch, th) if th.n_rows else batch.withColumn("suspicious", F.lit(False))
        out.write.mode("overwrite").parquet(f"{judged}/version={version}")

    query = (
        features.writeStream.foreachBatch(take).option("checkpointLocation", f"{snapshots.base}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = features.withColumn("suspicious", F.lit(True)).withColumn("version", F.lit(0)).schema
    if not snapshots.versions():
        return snapshots, spark.createDataFrame([], schema)
    return snapshots, spark.read.schema(schema).parquet(judged)

"""Area under the ROC curve within a stated tolerance, from a bounded number of rows for each class.

Scores are counted in cells of the log-odds axis, which are narrow towards 0 and 1. A cell that is
heavy for its class is split, at most twice; the last level is the single score. Only pairs inside a
cell can be counted wrongly, by half of them at most. With p and q for the share of a class's
positives and negatives in a cell, a cell is heavy where pq > (2t)^2. Cells left whole then err by
at most half the sum of pq <= t * sum of sqrt(pq) <= t, and no level has more than 1 / 2t heavy
cells, since the sums of p and of q are one. Cell counts add up, so neither the layout of the rows
nor the distribution of the scores shows in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.numeric import ratio
from flowloom.operators.bounds import fetched

CELLS = 64  # cells for each unit of log odds
SPLIT = 512  # parts of a heavy cell
MAX_HEAVY = 1_000_000  # heavy cells of all classes, which are broadcast


def _cell(score: Column, per_unit: int) -> Column:
    s = score.cast("double")
    edge = 1000 * per_unit
    inner = F.floor(F.log(s / (1 - s)) * per_unit)
    cell = F.when(s <= 0, F.lit(-edge)).when(s >= 1, F.lit(edge)).otherwise(inner)
    return F.coalesce(cell, F.lit(-edge).cast("long")).cast("int")


def _counts() -> list[Column]:
    return [F.count_if("_hit").alias("pos"), F.count_if(~F.col("_hit")).alias("neg")]


def _heavy(tolerance: float) -> Column:
    inside = F.col("pos").cast("double") * F.col("neg")
    return inside > F.lit((2 * tolerance) ** 2) * F.col("n_pos") * F.col("n_neg")


def _kept(cells: DataFrame, cell: str, what: str) -> DataFrame:
    found = fetched(cells.select("class", cell, "n_pos", "n_neg"), what, MAX_HEAVY)
    schema = f"class int, {cell} int, n_pos long, n_neg long"
    spark = cells.sparkSession
    return F.broadcast(spark.createDataFrame(found, schema) if found.num_rows else spark.createDataFrame([], schema))


def bounded_auc(preds: DataFrame, tolerance: float = 1e-3, true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """(class, n_pos, n_neg, roc_auc, error_bound) of each one-vs-rest problem.

    ``roc_auc`` is off by ``error_bound`` at most, which never exceeds ``tolerance``; scores are single
    precision and equal scores share their pair. Rows without a true label and missing scores take no
    part; a class without positives or negatives has no area. There are two scans, a third only
    where a cell is heavy after its first split.
    """
    if not 0 < tolerance < 0.5:
        raise ValueError("the tolerance lies between 0 and 0.5")
    long = preds.select(F.col(true).alias("_y"), F.posexplode(prob).alias("_c", "_p")).filter("_p IS NOT NULL AND _y IS NOT NULL")
    score = F.col("_p").cast("float")
    rows = long.select(
        F.col("_c").cast("int").alias("class"), score.alias("score"), (F.col("_y") == F.col("_c")).alias("_hit"),
        _cell(score, CELLS).alias("_c0"), _cell(score, CELLS * SPLIT).alias("_c1"),
    )
    whole = Window.partitionBy("class")
    coarse = rows.groupBy("class", "_c0").agg(*_counts())
    coarse = coarse.withColumn("n_pos", F.sum("pos").over(whole)).withColumn("n_neg", F.sum("neg").over(whole))
    first = _kept(coarse.filter(_heavy(tolerance)), "_c0", "heavy cells")
    marked = rows.join(first.select("class", "_c0", F.lit(True).alias("_h0")), ["class", "_c0"], "left")
    totals = F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")
    fine = rows.join(first, ["class", "_c0"]).groupBy("class", "_c1").agg(*_counts(), *totals)
    second = _kept(fine.filter(_heavy(tolerance)), "_c1", "heavy parts of cells")
    marked = marked.join(second.select("class", "_c1", F.lit(True).alias("_h1")), ["class", "_c1"], "left")
    split, single = F.col("_h0").isNotNull(), F.col("_h0").isNotNull() & F.col("_h1").isNotNull()
    leaves = marked.groupBy(
        "class",
        F.when(single, 2).when(split, 1).otherwise(0).alias("_level"),
        F.when(single, 0).when(split, F.col("_c1")).otherwise(F.col("_c0")).alias("_key"),
        F.when(single, F.col("score")).alias("_single"),
    ).agg(*_counts(), F.min("score").alias("low"), F.max("score").alias("high"))
    down = Window.partitionBy("class").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, 0)
    run = leaves.withColumn("_tp", F.sum("pos").over(down))
    won = F.sum(F.col("neg") * (F.col("_tp") - F.col("pos") / 2))
    unsure = F.sum(F.when(F.col("low") < F.col("high"), F.col("pos").cast("double") * F.col("neg")).otherwise(0.0)) / 2
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return run.groupBy("class").agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        ratio(won, pairs, None).alias("roc_auc"), ratio(unsure, pairs, None).alias("error_bound"),
    )

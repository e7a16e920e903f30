"""Ranking metrics and curves: ROC, precision-recall, AUC, average precision.

All start from the counts of positives and negatives per distinct (class, score), so rows with
equal scores meet in a partial aggregate. Running totals are taken inside cells of the log-odds
axis and shifted by the totals of the cells above. Scores are single precision: a cell of width
1/1024 then holds at most some 17,000 distinct scores and a class at most about 125,000 cells,
whatever the distribution, so neither window can outgrow a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.numeric import ratio
from flowloom.functions.vectors import let
from flowloom.operators.bounds import fetched
from flowloom.operators.sampling import stratified_sample

MICRO = -1  # class code of the curve over all flattened (row, class) decisions
CELLS_PER_LOGIT = 1024
GRID = 1000  # points of the common FPR axis


def present_classes(preds: DataFrame, true: str = "y_true") -> list[int]:
    """Codes that occur as true labels; at most one per class."""
    return sorted(fetched(preds.select(F.col(true).cast("int")).distinct(), "classes").column(0).to_pylist())


def renormalised(preds: DataFrame, present: Sequence[int], prob: str = "y_prob") -> DataFrame:
    """Probabilities of the present classes scaled to sum to one; others become NULL."""
    codes = set(present)
    used = F.array(*[F.lit(c in codes) for c in range(max(codes) + 1)])
    kept = F.transform(prob, lambda x, i: F.when(F.get(used, i), x.cast("double")))

    def scaled(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        return let(
            F.greatest(total, F.lit(1e-12)), lambda t: F.transform(v, lambda x: (x / t).cast("float"))
        )

    return preds.withColumn(prob, let(kept, scaled))


def score_counts(preds: DataFrame, true: str = "y_true", prob: str = "y_prob") -> DataFrame:
    """(class, score, pos, neg) for each distinct score of each one-vs-rest problem."""
    long = preds.select(F.col(true).alias("_y"), F.posexplode(prob).alias("_c", "_p")).filter(
        F.col("_p").isNotNull()
    )
    hit = F.col("_y") == F.col("_c")
    return (
        long.groupBy(F.col("_c").cast("int").alias("class"), F.col("_p").cast("float").alias("score"))
        .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    )


def micro_counts(counts: DataFrame, from_class: int = 0) -> DataFrame:
    """Classes from ``from_class`` on flattened into one problem, from the counts of ``score_counts``.

    Other classes are left out after the aggregate: a filter before it would keep this branch from
    sharing the shuffled counts with the per-class one.
    """
    wanted = F.col("class") >= from_class
    part = lambda c: F.coalesce(F.sum(F.when(wanted, F.col(c))), F.lit(0)).alias(c)
    return (
        counts.groupBy("score").agg(part("pos"), part("neg"))
        .filter(F.col("pos") + F.col("neg") > 0)
        .select(F.lit(MICRO).alias("class"), "score", "pos", "neg")
    )


def _cell(score: Column) -> Column:
    s = score.cast("double")
    edge = 1000 * CELLS_PER_LOGIT
    odds = F.floor(F.log(s / (1 - s)) * CELLS_PER_LOGIT)
    inner = F.when(s <= 0, F.lit(-edge)).when(s >= 1, F.lit(edge)).otherwise(odds)
    # never NULL: no null check is then added to one side of the join below, and both sides read
    # the same shuffled counts
    return F.coalesce(inner, F.lit(-edge).cast("long")).cast("int")


def _shifted(rows: DataFrame, totals: dict[str, Column], extra: Sequence[Column] = ()) -> DataFrame:
    """Join to every row the sums of the cells above its own and of its whole class."""
    cells = rows.groupBy("class", "_cell").agg(*[v.alias(k) for k, v in totals.items()], *extra)
    down = Window.partitionBy("class").orderBy(F.desc("_cell"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("class")
    cols = []
    for k in totals:
        cols.append(F.coalesce(F.sum(k).over(above), F.lit(0)).alias(f"{k}_above"))
        cols.append(F.sum(k).over(whole).alias(f"{k}_all"))
    if extra:
        cols.append(F.lead("_first").over(down).alias("_below"))
    return rows.join(cells.select("class", "_cell", *cols), ["class", "_cell"])


def cumulative(counts: DataFrame) -> DataFrame:
    """Running tp and fp from the highest score down, with class totals.

    Adds ``idx`` (0 for the highest score), ``n_points`` and ``corner``: false where the point
    lies on the straight line between its neighbours.
    """
    rows = counts.withColumn("_cell", _cell(F.col("score")))
    step = F.struct("pos", "neg")
    first = F.max_by(step, F.col("score")).alias("_first")
    joined = _shifted(
        rows, {"pos_n": F.sum("pos"), "neg_n": F.sum("neg"), "row_n": F.count(F.lit(1))}, [first]
    )
    inside = Window.partitionBy("class", "_cell").orderBy(F.desc("score"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.coalesce(F.lead(step).over(inside), F.col("_below"))
    out = joined.select(
        "class",
        "_cell",
        "score",
        "pos",
        "neg",
        (F.col("pos_n_above") + F.sum("pos").over(upto)).alias("tp"),
        (F.col("neg_n_above") + F.sum("neg").over(upto)).alias("fp"),
        F.col("pos_n_all").alias("n_pos"),
        F.col("neg_n_all").alias("n_neg"),
        (F.col("row_n_above") + F.row_number().over(inside) - 1).alias("idx"),
        F.col("row_n_all").alias("n_points"),
        following.alias("_next"),
    )
    straight = (F.col("_next.pos") == F.col("pos")) & (F.col("_next.neg") == F.col("neg"))
    corner = (F.col("idx") == 0) | F.col("_next").isNull() | ~straight
    return out.withColumn("corner", corner).drop("_next")


# ------------------------------------------------------------------ areas
def areas(cum: DataFrame) -> DataFrame:
    """Per class ROC area with half-counted ties, and average precision as a step sum.

    Both are NULL unless the class has positives and negatives.
    """
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    step = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    usable = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    sums = cum.groupBy("class").agg(
        won.alias("_won"), step.alias("_step"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")
    )
    return sums.select(
        "class",
        "n_pos",
        "n_neg",
        F.when(usable, F.col("_won") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
        F.when(usable, F.col("_step") / F.col("n_pos")).alias("pr_auc"),
    )


def ovr_areas(preds: DataFrame) -> DataFrame:
    """ROC area and average precision of each class on raw probabilities."""
    return areas(cumulative(score_counts(preds)))


def auc_macro_weighted(preds: DataFrame, num_classes: int) -> DataFrame:
    """Macro and prevalence-weighted one-vs-rest AUC over present classes, renormalised."""
    present = present_classes(preds)
    used, skipped = len(present), num_classes - len(present)
    if used < 2:
        empty = F.lit(None).cast("double")
        return preds.sparkSession.range(1).select(
            empty.alias("auc_macro"), empty.alias("auc_weighted"),
            F.lit(used).alias("classes_used"), F.lit(skipped).alias("classes_skipped"),
        )
    per = areas(cumulative(score_counts(renormalised(preds, present))))
    return per.agg(
        F.avg("roc_auc").alias("auc_macro"),
        (F.sum(F.col("roc_auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc_weighted"),
        F.lit(used).alias("classes_used"),
        F.lit(skipped).alias("classes_skipped"),
    )


def auc_micro(preds: DataFrame) -> DataFrame:
    """AUC of all flattened (row, present class) decisions on renormalised probabilities."""
    present = present_classes(preds)
    if len(present) < 2:
        return preds.sparkSession.range(1).select(F.lit(None).cast("double").alias("auc_micro"))
    flat = micro_counts(score_counts(renormalised(preds, present)))
    return areas(cumulative(flat)).select(F.col("roc_auc").alias("auc_micro"))


def raw_and_renormalised_areas(preds: DataFrame, num_classes: int) -> DataFrame:
    """Areas on raw probabilities (class c), renormalised ones (class K + c) and their micro form (-1).

    Both sets of scores are exploded in one scan and share one set of running totals.
    """
    present = present_classes(preds)
    both = renormalised(preds.withColumn("_raw", F.col("y_prob")), present).select(
        "y_true", F.concat(F.col("_raw"), F.col("y_prob")).alias("_p")
    )
    long = both.select(F.col("y_true").alias("_y"), F.posexplode("_p").alias("_c", "_s")).filter(F.col("_s").isNotNull())
    hit = F.col("_y") == F.col("_c") % num_classes
    counts = long.groupBy(F.col("_c").cast("int").alias("class"), F.col("_s").cast("float").alias("score")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    return areas(cumulative(counts.unionByName(micro_counts(counts, num_classes))))


def average_precision(preds: DataFrame) -> DataFrame:
    """Average precision per class and micro (class -1), with the macro mean over usable classes."""
    per = areas(cumulative(_all_counts(preds, True))).select("class", F.col("pr_auc").alias("ap"))
    macro = F.avg(F.when(F.col("class") >= 0, F.col("ap"))).over(Window.partitionBy(F.lit(0)))
    return per.withColumn("ap_macro", macro)


def approx_auc(preds: DataFrame, bins: int = 4096) -> DataFrame:
    """One-vs-rest AUC on binned scores: at most classes x bins rows leave the first aggregate."""
    long = preds.select(F.col("y_true").alias("_y"), F.posexplode("y_prob").alias("class", "_p"))
    hit = F.col("_y") == F.col("class")
    binned = long.groupBy("class", F.floor(F.col("_p").cast("double") * bins).alias("_bin")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    down = Window.partitionBy("class").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    run = binned.withColumn("_tp", F.sum("pos").over(down))
    won = F.sum(F.col("neg") * (F.col("_tp") - F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return run.groupBy("class").agg(ratio(won, pairs, None).alias("roc_auc"))


# ------------------------------------------------------------------ curves
def _all_counts(preds: DataFrame, micro: bool) -> DataFrame:
    counts = score_counts(preds)
    return counts.unionByName(micro_counts(counts)) if micro else counts


def roc_points(preds: DataFrame, micro: bool = True, max_points: int | None = None) -> DataFrame:
    """Corners of the ROC curves: (class, idx, fpr, tpr, threshold).

    Every curve starts at the origin, whose threshold is NULL. Classes without positives or
    without negatives are left out. ``max_points`` keeps that many evenly spaced points.
    """
    cum = cumulative(_all_counts(preds, micro)).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    corners = cum.filter("corner")
    numbered = _shifted(corners, {"kept": F.count(F.lit(1))})
    inside = Window.partitionBy("class", "_cell").orderBy(F.desc("score"))
    nth = numbered.withColumn("_nth", F.col("kept_above") + F.row_number().over(inside))

    def point(idx: Column, fpr: Column, tpr: Column, threshold: Column) -> Column:
        return F.struct(
            F.col("class"), idx.cast("long").alias("idx"), (F.col("kept_all") + 1).alias("n_points"),
            fpr.alias("fpr"), tpr.alias("tpr"), threshold.cast("double").alias("threshold"),
        )

    here = point(F.col("_nth"), F.col("fp") / F.col("n_neg"), F.col("tp") / F.col("n_pos"), F.col("score"))
    origin = point(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(None))
    return _finish(_with_extra(nth, F.col("_nth") == 1, here, origin), max_points)


def _with_extra(rows: DataFrame, where: Column, here: Column, extra: Column) -> DataFrame:
    """Every row as ``here``; rows that satisfy ``where`` also as ``extra``. No second pass is needed."""
    return rows.select(F.inline(F.when(where, F.array(here, extra)).otherwise(F.array(here))))


def pr_points(preds: DataFrame, micro: bool = True, max_points: int | None = None) -> DataFrame:
    """Precision and recall per threshold in ascending order, then the point (1, 0)."""
    cum = cumulative(_all_counts(preds, micro)).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))

    def point(idx: Column, recall: Column, precision: Column, threshold: Column) -> Column:
        return F.struct(
            F.col("class"), idx.alias("idx"), (F.col("n_points") + 1).alias("n_points"),
            recall.alias("recall"), precision.alias("precision"), threshold.cast("double").alias("threshold"),
        )

    here = point(
        F.col("n_points") - 1 - F.col("idx"), F.col("tp") / F.col("n_pos"),
        F.col("tp") / (F.col("tp") + F.col("fp")), F.col("score"),
    )
    end = point(F.col("n_points"), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    return _finish(_with_extra(cum, F.col("idx") == 0, here, end), max_points)


def _finish(points: DataFrame, max_points: int | None) -> DataFrame:
    return (thin_points(points, max_points) if max_points else points).drop("n_points")


def thin_points(points: DataFrame, max_points: int) -> DataFrame:
    """Rows whose idx is floor(i * (m - 1) / (k - 1)) for some i: k even steps, both ends kept."""
    if max_points < 2:
        raise ValueError("max_points must be at least 2")
    r, m1, k1 = F.col("idx"), F.col("n_points") - 1, F.lit(max_points - 1)
    i = F.ceil(r * k1 / m1)
    return points.filter((F.col("n_points") <= max_points) | (F.floor(i * m1 / k1) == r))


def macro_roc(preds: DataFrame) -> DataFrame:
    """Class ROC curves interpolated on an even FPR grid and averaged: (idx, fpr, tpr, auc).

    Between two grid points only the first and last curve point matter, so each class shrinks to
    at most GRID rows before any ordering. Cell borders are compared in whole numbers.
    """
    steps = GRID - 1
    cum = cumulative(score_counts(preds)).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    g = F.expr(f"(fp * {steps} + n_neg - 1) div n_neg")  # smallest grid index at or right of the point
    # each curve's first row also brings the empty grid and the origin
    point = F.struct(F.col("fp"), F.col("tp"))
    empty = F.lit(None).cast("struct<fp:bigint,tp:bigint>")
    zero = F.lit(0).cast("long")
    here = F.struct(g.cast("int").alias("g"), point.alias("lo"), point.alias("hi"))
    origin = F.struct(F.lit(0).alias("g"), empty.alias("lo"), F.struct(zero.alias("fp"), zero.alias("tp")).alias("hi"))
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(i.alias("g"), empty.alias("lo"), empty.alias("hi"))
    )
    first = F.concat(F.array(here, origin), grid)
    merged = (
        cum.select(
            "class", "n_pos", "n_neg", F.inline(F.when(F.col("idx") == 0, first).otherwise(F.array(here)))
        )
        .groupBy("class", "g")
        .agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        )
    )
    order = Window.partitionBy("class").orderBy("g")
    left = F.last("hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    bracket = merged.select("class", "g", "n_pos", "n_neg", left.alias("l"), right.alias("r"))
    lf, lt, rf, rt = F.col("l.fp"), F.col("l.tp"), F.col("r.fp"), F.col("r.tp")
    x = F.col("g") * F.col("n_neg") / steps
    exact = (lf * steps == F.col("g") * F.col("n_neg")) | F.col("r").isNull()
    y = F.when(exact, lt.cast("double")).otherwise(lt + (rt - lt) * (x - lf) / (rf - lf))
    mean = bracket.select("g", (y / F.col("n_pos")).alias("y")).groupBy("g").agg(F.avg("y").alias("tpr"))
    by_g = Window.orderBy("g")  # GRID rows
    strip = (F.col("tpr") + F.lag("tpr").over(by_g)) / (2.0 * steps)
    return mean.withColumn("_a", strip).select(
        F.col("g").alias("idx"),
        (F.col("g") / steps).alias("fpr"),
        "tpr",
        F.sum("_a").over(Window.partitionBy(F.lit(0))).alias("auc"),
    )


def curve_sample(preds: DataFrame, cap: int, key: str = "row_key", seed: int = 42) -> DataFrame:
    """A class-proportional sample of ``cap`` rows for a caller who asks for one; no curve here takes it by itself."""
    return stratified_sample(preds, key, "y_true", cap, seed)

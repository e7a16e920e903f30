"""Class-capped and proportional samples, splits, leakage checks and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.bounds import MAX_CLASSES, bounded, labelled, pinned
from flowloom.operators.ranking import hash_cuts, hash_rank, part_by_cuts

SPLITS = ("test", "val", "train")


# ------------------------------------------------------------------ samples per class
def class_cap(counts: DataFrame, target: int, n: str = "n") -> DataFrame:
    """Smallest cap whose capped total reaches ``target``: one row (cap).

    With counts in ascending order and P the sum of the smaller ones, every class i demands at
    least ceil((target - P) / classes left) rows; the cap is the largest demand.
    """
    asc = Window.orderBy(n)
    t = bounded(counts.select(F.col(n).cast("long").alias(n)), MAX_CLASSES, "classes").select(
        n,
        F.coalesce(F.sum(n).over(asc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"),
        (F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) - F.row_number().over(asc) + 1).alias("_left"),
    )
    lack = F.lit(target) - F.col("_p")
    demand = F.when(lack > 0, F.floor((lack + F.col("_left") - 1) / F.col("_left"))).otherwise(0)
    total, largest = F.sum(n), F.max(n)
    return t.agg(
        F.when(total <= target, largest).otherwise(F.greatest(F.lit(1), F.max(demand))).cast("long").alias("cap")
    )


def _sample_limits(df: DataFrame, label: str, target: int, mode: str) -> DataFrame:
    """(_g, _lims, n, take) per class; without a useful target every row is taken."""
    counts = df.groupBy(F.col(label).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    counts = labelled(counts, "_g", label)
    counts = pinned(counts, f"classes in {label}")
    whole = Window.partitionBy(F.lit(0))
    n_all = F.sum("n").over(whole)
    if mode == "capped":
        cap = class_cap(counts, target).first()["cap"]  # one number
        take = F.least(F.col("n"), F.lit(cap))
    elif mode == "proportional":
        take = F.least(F.col("n"), F.greatest(F.lit(1), F.rint(F.col("n") * (F.lit(float(target)) / n_all))))
    else:
        raise ValueError(f"unknown sampling mode {mode!r}")
    keep_all = (F.lit(target) <= 0) | (F.lit(target) >= n_all)
    sized = counts.withColumn("_all", keep_all)
    sized = sized.withColumn("take", F.when(F.col("_all"), F.col("n")).otherwise(take).cast("long"))
    return sized.withColumn("_lims", F.array("take"))


def subsample(
    df: DataFrame, key: str, label: str, target: int, mode: str = "capped", seed: int = 42
) -> DataFrame:
    """Rows kept by a capped or proportional draw per class."""
    limits = _sample_limits(df, label, target, mode)
    cuts = hash_cuts(df, key, seed, group=label, limit_table=limits.select("_g", "_lims"))
    parts = part_by_cuts(df, cuts, key, seed, ("in", "out"), group=label, out="_part")
    return parts.filter(F.col("_part") == "in").drop("_part")


def subsample_report(df: DataFrame, label: str, target: int, mode: str = "capped") -> DataFrame:
    """Rows per class before and after, whether a class is kept whole, and both totals."""
    whole = Window.partitionBy(F.lit(0))
    return _sample_limits(df, label, target, mode).select(
        F.col("_g").alias("class"),
        F.col("n").alias("n_before"),
        F.col("take").alias("n_after"),
        (F.col("n") == F.col("take")).alias("kept_whole"),
        F.sum("n").over(whole).alias("total_before"),
        F.sum("take").over(whole).alias("total_after"),
    )


def stratified_sample(
    df: DataFrame, key: str, label: str, max_rows: int, seed: int = 42
) -> DataFrame:
    """All rows if they fit, otherwise a draw in natural class proportions."""
    return subsample(df, key, label, max_rows, "proportional", seed)


def plain_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement."""
    cuts = hash_cuts(df, key, seed, lambda size: [F.least(size, F.lit(n))])
    parts = part_by_cuts(df, cuts, key, seed, ("in", "out"), out="_part")
    return parts.filter(F.col("_part") == "in").drop("_part")


def first_rows(df: DataFrame, key: str, n: int, cells: int = 65_536) -> DataFrame:
    """The n rows with the smallest integer keys, in key order.

    A histogram over equal key ranges shows which range holds the n-th key, so the final sort
    sees little more than n rows.
    """
    span = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    row = span.first()  # two numbers
    if row is None or row["_lo"] is None:
        return df.limit(0)
    width = max(1, (row["_hi"] - row["_lo"]) // cells + 1)
    cell = F.floor((F.col(key) - F.lit(row["_lo"])) / F.lit(width))
    hist = df.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_c"))
    upto = hist.select("_cell", (F.sum("_c").over(Window.orderBy("_cell"))).alias("_upto"))
    edge = upto.filter(F.col("_upto") >= n).agg(F.min("_cell")).first()[0]  # one number
    if edge is not None:
        df = df.filter(F.col(key) < F.lit(row["_lo"] + (edge + 1) * width))
    return df.orderBy(key).limit(n)


# ------------------------------------------------------------------ splits
def split_sizes(n: Column, test_size: float, val_size: float) -> tuple[Column, Column]:
    """Half-even rounded test size, and validation size taken from what is left."""
    n_test = F.rint(n * F.lit(test_size))
    n_val = F.rint((n - n_test) * F.lit(val_size))
    return n_test, n_val


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    test_size: float = 0.30,
    val_size: float = 0.15,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Exact per-class test, validation and train shares; the rows are not shuffled.

    A NULL label is an error, and so is a key that repeats at the edge of a split.
    """

    def limits(n: Column) -> Sequence[Column]:
        n_test, n_val = split_sizes(n, test_size, val_size)
        return [n_test, n_test + n_val]

    cuts = hash_cuts(df, key, seed, limits, group=label)
    return part_by_cuts(df, cuts, key, seed, SPLITS, group=label, out=out)


def group_split(
    df: DataFrame,
    group: str,
    test_size: float = 0.30,
    val_size: float = 0.15,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Whole groups go to one split, by their rank among the distinct groups.

    Only the distinct group keys are shuffled; a group with very many rows costs nothing extra.
    """

    def limits(n: Column) -> Sequence[Column]:
        n_test, n_val = split_sizes(n, test_size, val_size)
        return [n_test, n_test + n_val]

    cuts = hash_cuts(df.select(group).distinct(), group, seed, limits)
    return part_by_cuts(df, cuts, group, seed, SPLITS, out=out)


def split_leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Pairwise overlaps, coverage and sizes: one row."""
    flags = [F.max((F.col(split) == s).cast("int")).alias(s) for s in SPLITS]
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *flags)
    both = lambda a, b: F.sum(F.col(a) * F.col(b)).cast("long")
    sizes = per_key.agg(
        F.sum("_rows").alias("n_total"),
        F.count(F.lit(1)).alias("n_keys"),
        *[F.sum(s).cast("long").alias(f"n_{s}") for s in ("train", "val", "test")],
        both("train", "val").alias("overlap_train_val"),
        both("train", "test").alias("overlap_train_test"),
        both("val", "test").alias("overlap_val_test"),
    )
    covered = F.col("n_train") + F.col("n_val") + F.col("n_test")
    overlap = F.col("overlap_train_val") + F.col("overlap_train_test") + F.col("overlap_val_test")
    return sizes.select(
        "*",
        *[F.round(F.col(f"n_{s}") / F.col("n_total"), 6).alias(f"frac_{s}") for s in ("train", "val", "test")],
        (overlap == 0).alias("is_disjoint"),
        (covered == F.col("n_total")).alias("covers_all"),
    )


def assert_no_leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """The report of ``split_leakage``; reading it fails when splits overlap or miss rows."""
    report = split_leakage(df, key, split)
    ok = F.col("is_disjoint") & F.col("covers_all")
    return report.filter(
        F.when(~ok, F.raise_error(F.lit("splits overlap or do not cover all rows")).cast("boolean")).otherwise(F.lit(True))
    )


def split_class_counts(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows per class with a column per split."""
    return df.groupBy(label).agg(
        *[F.count(F.when(F.col(split) == s, 1)).alias(s) for s in ("train", "val", "test")]
    )


# ------------------------------------------------------------------ batches
def epoch_batches(
    df: DataFrame, key: str, batch_size: int, epoch: int, seed: int = 42, drop_last: bool = False
) -> DataFrame:
    """A permutation per (seed, epoch) cut into batches: adds batch_id and position."""
    ranked = hash_rank(df, key, f"{seed}|{epoch}", out="_rank")
    position = F.col("_rank") - 1
    out = ranked.select(
        *df.columns,
        F.floor(position / batch_size).cast("long").alias("batch_id"),
        (position % batch_size).cast("long").alias("position"),
    )
    if not drop_last:
        return out
    return out.filter(F.col("batch_id") < df.count() // batch_size)


def resume_batches(batches: DataFrame, skip: int) -> DataFrame:
    """What is left of an epoch after ``skip`` batches."""
    return batches.filter(F.col("batch_id") >= skip)


def row_subset(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys.select(key), key, "left_semi")


__all__ = [
    "assert_no_leakage", "class_cap", "epoch_batches", "first_rows", "group_split", "plain_sample",
    "resume_batches", "row_subset", "split_class_counts", "split_leakage", "split_sizes",
    "stratified_sample", "stratified_split", "subsample", "subsample_report",
]

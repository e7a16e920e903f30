"""From a raw flow table to the scaled feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import labels as L
from flowloom.operators import sampling as S
from flowloom.operators import stats as E
from flowloom.operators.bounds import pinned, side_by_side


#: Features of a row as one array, under a name of its own.
MATRIX = "_fl_features"


@dataclass(frozen=True)
class Prepared:
    rows: DataFrame  # selected rows with label, code and split
    classes: DataFrame
    stats: DataFrame  # scaler statistics of all features
    drops: DataFrame
    scaler: E.Scaler  # kept columns only
    scaled: DataFrame  # key, label, code, split and scaled kept features


def prepare_dataset(
    df: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    merge: Mapping[str, str] | None = None,
    target_rows: int | None = None,
    mode: str = "capped",
    missing_threshold: float = 0.80,
    check_splits: bool = True,
    seed: int = 42,
    verify_rows: int | None = None,
) -> Prepared:
    """Merge labels, sample, split, fit on train rows, prune columns, scale - in this order.

    The statistics and the column decisions are read by the driver (one row per feature); the
    rows pass through narrow steps only and can be written straight to a table. Duplicate columns
    are compared on all train rows, or on ``verify_rows`` of them, in a scan of their own only where fingerprints agree. Splits that overlap or miss rows are an error, and so are keys
    that repeat, which would end up in two splits.
    """
    slim = df.select(key, label, *[F.col(f"`{c}`") for c in features])
    if merge:
        raw = L.class_constants(slim, label)
        L.require_known(raw, label, merge)
        classes = L.class_constants(L.merge_labels(raw, label, merge, check=False), label)
    else:
        classes = L.class_constants(slim, label)
    merged = L.merge_labels(slim, label, merge or {}, check=False)
    chosen = merged
    if target_rows:
        chosen = S.subsample(merged, key, label, target_rows, mode, seed)
    # The features become one array right above the scan, and the passes over the rows carry that array.
    packed = chosen.withColumn(MATRIX, E.as_matrix(features))
    both = S.stratified_split(packed, key, label, seed=seed).join(F.broadcast(classes), label)
    rows = both.drop(MATRIX)
    stats = pinned(E.scaler_stats(E.column_stats(both, features, key=key, matrix=MATRIX)), "feature columns")
    train = rows.filter(F.col("split") == "train")
    if check_splits:
        S.assert_no_leakage(rows.select(key, "split"), key).collect()  # one row
    drops = E.column_drop_report(stats, train, missing_threshold, verify_rows=verify_rows, key=key, seed=seed)
    drops = pinned(drops, "feature columns")
    scaler = E.Scaler.collect(E.subset_stats(stats, drops))
    scaled = E.minmax_scale(both.select(key, label, "code", "split", MATRIX), scaler, MATRIX, features)
    return Prepared(rows, classes, stats, drops, scaler, scaled)


def data_profile(p: Prepared, n_dataset: DataFrame, label: str) -> DataFrame:
    """Totals, features, classes, class counts, split sizes and cache size: one row.

    ``n_dataset`` has the row count of the whole dataset as n_rows.
    """
    n_features = len(p.scaler.columns)
    per = p.rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")],
    )
    text = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct(label, "n"))),
            lambda s: F.concat_ws("=", s[label], s["n"].cast("string")),
        ),
        ";",
    )
    one = per.agg(
        F.sum("n").alias("total_rows"),
        F.lit(n_features).alias("n_features"),
        F.count(F.lit(1)).cast("int").alias("num_class"),
        text.alias("class_counts"),
        *[F.sum(s).alias(f"n_{s}") for s in ("train", "val", "test")],
        (F.sum("n") * n_features * 4).alias("cache_bytes"),
    )
    whole = n_dataset.select(F.col("n_rows").alias("total_rows_in_dataset"))
    return side_by_side([one, whole])

"""Label cleaning, merging, encoding and counting."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.text import strip_label
from flowloom.operators.bounds import MAX_CLASSES, bounded, fetched, labelled, small


def strip_labels(df: DataFrame, label: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or label, strip_label(label))


def merge_table(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    table = pa.table({"src": list(mapping), "dst": list(mapping.values())}, pa.schema([("src", pa.string()), ("dst", pa.string())]))
    return df.sparkSession.createDataFrame(table)


def unknown_sources(df: DataFrame, label: str, mapping: Mapping[str, str]) -> DataFrame:
    """Merge sources that name no label of the data."""
    known = df.select(F.col(label).alias("src")).distinct()
    return merge_table(df, mapping).select("src").join(known, "src", "left_anti")


def require_known(df: DataFrame, label: str, mapping: Mapping[str, str]) -> None:
    """Error when the merge map names a label that never occurs."""
    if mapping:
        bad = [r.src for r in unknown_sources(df, label, mapping).collect()]  # at most the map
        if bad:
            raise ValueError(f"merge map names labels that do not occur: {sorted(bad)}")


def merge_labels(
    df: DataFrame, label: str, mapping: Mapping[str, str], check: bool = True
) -> DataFrame:
    """Replace synonyms by their canonical label. A source that never occurs is an error."""
    if not mapping:
        return df
    if check:
        require_known(df, label, mapping)
    # names that no table has, whatever its columns are called
    table = small(merge_table(df, mapping).toDF("__merge_src", "__merge_dst"), "merge map")
    return (
        df.join(table, F.col(label) == F.col("__merge_src"), "left")
        .withColumn(label, F.coalesce("__merge_dst", label))
        .drop("__merge_src", "__merge_dst")
    )


def class_table(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Sorted classes with their position as a 16-bit code; too many classes fail the query."""
    classes = bounded(labelled(df.select(label).distinct(), label), MAX_CLASSES, f"classes in {label}")
    position = F.row_number().over(Window.orderBy(label)) - 1
    return classes.select(label, position.cast("short").alias(code))


def class_constants(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """``class_table`` held as a constant of later plans, from labels read once."""
    names = sorted(fetched(labelled(df.select(label).distinct(), label), f"classes in {label}").column(0).to_pylist())
    table = pa.table({label: pa.array(names, pa.string()), code: pa.array(range(len(names)), pa.int16())})
    return df.sparkSession.createDataFrame(table)


def encode_labels(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    return df.join(F.broadcast(class_table(df, label, code)), label)


def class_counts(df: DataFrame, label: str, classes: DataFrame | None = None) -> DataFrame:
    """Rows per class; classes given in ``classes`` but absent from ``df`` count 0."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        return counts
    return classes.select(label).join(counts, label, "left").fillna(0, subset=["n"])


def label_merge_audit(df: DataFrame, label: str, mapping: Mapping[str, str]) -> DataFrame:
    """Per canonical label: rows, the labels merged into it and their rows before merging."""
    raw = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    table = small(merge_table(df, mapping), "merge map")
    merged = raw.join(table, F.col(label) == F.col("src"), "left").withColumn(
        "class", F.coalesce("dst", label)
    )
    return merged.groupBy("class").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("src").isNotNull(), F.col("n"))), F.lit(0)).alias("n_merged"),
        F.concat_ws(",", F.sort_array(F.collect_set("src"))).alias("merged_from"),
    )


def benign_class(classes: DataFrame, label: str, benign: str = "BENIGN") -> DataFrame:
    """The class equal to ``benign`` in any letter case; its absence fails the query."""
    hit = classes.filter(F.upper(label) == benign.upper()).agg(F.min(label).alias(label))
    missing = F.raise_error(F.lit(f"no class named {benign}")).cast("string")
    return hit.select(F.coalesce(F.col(label), missing).alias(label))


def label_count_reconcile(df: DataFrame, label: str, rows_by_file: DataFrame) -> DataFrame:
    """Labels read per file against the rows of that file: (file, n_rows, n_labels, ok).

    Files are told apart by their whole path, so equal names in two folders stay two rows.
    """
    labels = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(label).alias("n_labels")
    )
    return (
        rows_by_file.select("path", "file", "n_rows")
        .join(labels, "path", "left")
        .fillna(0, subset=["n_labels"])
        .select("file", "n_rows", "n_labels", (F.col("n_rows") == F.col("n_labels")).alias("ok"))
    )


def label_profile(df: DataFrame, label: str) -> DataFrame:
    """Count and percent per label, most common first, with rarest class and imbalance."""
    total = Window.partitionBy(F.lit(0))
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    n_all = F.sum("n").over(total)
    return (
        counts.select(
            "label",
            "n",
            F.round(100.0 * F.col("n") / n_all, 6).alias("percent"),
            F.min_by("label", F.struct("n", "label")).over(total).alias("rarest"),
            F.floor(n_all / F.min("n").over(total)).cast("long").alias("imbalance"),
        )
        .orderBy(F.desc("n"), "label")
    )

"""Table, CSV and JSON sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.numeric import r6
from flowloom.functions.text import normalise_name
from flowloom.operators.bounds import bounded, side_by_side


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write Parquet, read it back, and require the row count seen while writing."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = df.sparkSession.read.parquet(path)
    n_written, n_read = seen.get["n"], back.count()
    if n_read != n_written:
        raise RuntimeError(f"{path}: wrote {n_written} rows, found {n_read}")
    return back


def write_feature_table(scaled: DataFrame, path: str, selected: DataFrame | None = None, key: str = "row_key",
                        partition_by: Sequence[str] = ()) -> DataFrame:
    """Scaled features of the selected rows as a Parquet table."""
    rows = scaled if selected is None else scaled.join(selected.select(key), key, "left_semi")
    return write_table(rows, path, partition_by)


def report_format(df: DataFrame) -> DataFrame:
    """Floating columns with six decimals, non-finite as NULL."""
    floating = (T.DoubleType, T.FloatType, T.DecimalType)
    return df.select(
        *[
            r6(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, floating) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header in report format; missing values are empty fields."""
    report_format(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def union_fields(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of tables with differing columns; absent values become empty strings."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns])


def schema_fingerprint(stats: DataFrame, label: str) -> DataFrame:
    """One row with hashes of the ordered columns and of the rounded scaler values.

    ``stats`` has one row per feature column. Means count with nine digits, so that the order in
    which partitions are summed does not show in the hash.
    """
    rows = bounded(stats, 1_000_000, "feature columns")
    num = lambda c: F.format_string("%.9f", F.round(F.col(c), 9))
    col = F.struct("ordinal", "column")
    mean = F.format_string("%.8e", F.col("mean"))
    full = F.struct(F.col("ordinal"), F.concat_ws(":", "column", num("min"), num("max"), mean).alias("v"))
    agg = rows.agg(
        F.count(F.lit(1)).cast("int").alias("n_features"),
        F.sort_array(F.collect_list(col)).alias("_c"),
        F.sort_array(F.collect_list(full)).alias("_v"),
    )
    names = F.array_join(F.transform("_c", lambda s: s["column"]), "\n")
    values = F.array_join(F.transform("_v", lambda s: s["v"]), "\n")
    return agg.select(
        "n_features",
        F.sha2(F.concat(names, F.lit(f"\nlabel={normalise_name(label)}")), 256).alias("schema_hash"),
        F.sha2(values, 256).alias("scaler_hash"),
    )


def cache_manifest(fingerprint: DataFrame, files: DataFrame, n_cached: DataFrame) -> DataFrame:
    """Hashes, rows cached (column n_rows of ``n_cached``), rows and files of the dataset: one row."""
    totals = files.filter(F.col("file").isNull()).select(
        F.col("n_rows").alias("n_rows_in_dataset"), "n_files", "bytes"
    )
    return side_by_side([fingerprint, totals, n_cached.select(F.col("n_rows").alias("n_rows_cached"))])

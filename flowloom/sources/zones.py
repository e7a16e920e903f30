"""Zone maps: bounds of every column in every row group, and scans that open only what can match.

A zone map is a table, so a data set of millions of files is pruned by a filter and an aggregate before
any of its files is opened. A row group is left out only where its bounds prove that no row matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.numeric import finite_or_null
from flowloom.sources.parquet import _uri, list_files

Range = tuple[float | None, float | None]
_ZONES = "path string, file string, row_group int, column string, n_rows long, n_null long, low double, high double, bytes long"


def _bound(value: object, towards: float) -> float | None:
    """The value as a double that is not inside of it; None where it bounds nothing."""
    from decimal import Decimal

    if isinstance(value, bool) or not isinstance(value, int | float | Decimal):
        return None
    if isinstance(value, Decimal) and not value.is_finite():
        return None
    try:
        x = float(value)
    except OverflowError:
        return towards
    if math.isnan(x):
        return None
    inside = x < value if towards > 0 else x > value
    return math.nextafter(x, towards) if inside else x


def _bounds(stats: object) -> tuple[int | None, float | None, float | None]:
    """(nulls, low, high) of a column chunk; a side without a usable value is open."""
    if stats is None:
        return None, None, None
    nulls = stats.null_count if stats.has_null_count else None
    if not stats.has_min_max:
        return nulls, None, None
    low, high = _bound(stats.min, -math.inf), _bound(stats.max, math.inf)
    return (nulls, None, None) if low is None or high is None else (nulls, low, high)


def _read_zones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    names = [part.split()[0] for part in _ZONES.split(", ")]
    for pdf in batches:
        for row in pdf.itertuples():
            where, name = fs.FileSystem.from_uri(_uri(row.path))
            with where.open_input_file(name) as handle:
                footer = pq.ParquetFile(handle).metadata
            out = []
            for g in range(footer.num_row_groups):
                group = footer.row_group(g)
                for c in range(group.num_columns):
                    chunk = group.column(c)
                    fixed = (row.path, row.file, g, chunk.path_in_schema, group.num_rows)
                    out.append((*fixed, *_bounds(chunk.statistics), chunk.total_compressed_size))
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"n_null": "Int64", "low": "float64", "high": "float64"})


def _tasks(spark: SparkSession, tasks: int | None) -> int:
    # A number of its own: adaptive execution would put these small rows, each of which stands for a
    # file or a row group, into one task.
    return tasks or 4 * spark.sparkContext.defaultParallelism


def zone_maps(spark: SparkSession, path: str, pattern: str = "*.parquet", tasks: int | None = None) -> DataFrame:
    """(path, file, row_group, column, n_rows, n_null, low, high, bytes) from the footers, read in the tasks.

    ``low`` and ``high`` enclose the numbers of a column; they are NULL where the footer has no usable
    bounds: no statistics, NaN, or a column that is no number. ``bytes`` is the compressed size.
    """
    files = list_files(spark, path, pattern).select("path", "file")
    return files.repartition(_tasks(spark, tasks), "path").mapInPandas(_read_zones, _ZONES)


def _outside(ranges: Mapping[str, Range]) -> Column:
    """True for a zone that proves that no row of its group is in the range of its column."""
    cases = []
    for name, (lo, hi) in ranges.items():
        empty = F.col("n_null") == F.col("n_rows")
        below = F.col("high") < F.lit(lo) if lo is not None else F.lit(False)
        above = F.col("low") > F.lit(hi) if hi is not None else F.lit(False)
        cases.append((F.col("column") == F.lit(name)) & F.coalesce(empty | below | above, F.lit(False)))
    return reduce(lambda a, b: a | b, cases, F.lit(False))


def marked_groups(zones: DataFrame, ranges: Mapping[str, Range]) -> DataFrame:
    """(path, row_group, n_rows, kept): whether a row group may hold rows with all columns in range."""
    return zones.groupBy("path", "row_group").agg(
        F.max("n_rows").alias("n_rows"), (~F.bool_or(_outside(ranges))).alias("kept")
    )


def _reader(columns: Sequence[str]):
    names = list(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for batch in batches:
            for path, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, name = fs.FileSystem.from_uri(_uri(path))
                with where.open_input_file(name) as handle:
                    file = pq.ParquetFile(handle)
                    there = [c for c in names if c in file.schema_arrow.names]
                    if not there:
                        n = file.metadata.row_group(group).num_rows
                        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.float64()) for _ in names], names=names)
                        continue
                    for part in file.iter_batches(row_groups=[group], columns=there):
                        at = part.schema.get_field_index
                        arrays = [
                            pc.cast(part.column(at(c)), pa.float64(), safe=False) if c in there
                            else pa.nulls(part.num_rows, pa.float64())
                            for c in names
                        ]
                        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return read


def zoned_scan(zones: DataFrame, columns: Sequence[str], ranges: Mapping[str, Range], tasks: int | None = None) -> DataFrame:
    """Numeric columns as doubles, non-finite as missing, of the rows with every column of ``ranges`` in range.

    Both ends of a range belong to it, None leaves an end open; a missing value is in no range. Row groups
    that cannot match are not opened, and of the others only the columns in use are read. A file that
    lacks a column has it missing in all its rows.
    """
    needed = list(dict.fromkeys([*columns, *ranges]))
    groups = marked_groups(zones, ranges).filter("kept").select("path", "row_group")
    spread = groups.repartition(_tasks(zones.sparkSession, tasks), "path", "row_group")
    rows = spread.mapInArrow(_reader(needed), ", ".join(f"`{c}` double" for c in needed))
    rows = rows.select(*[finite_or_null(F.col(f"`{c}`")).alias(c) for c in needed])
    for name, (lo, hi) in ranges.items():
        value = F.col(f"`{name}`")
        rows = rows.filter(value.isNotNull())
        rows = rows if lo is None else rows.filter(value >= F.lit(float(lo)))
        rows = rows if hi is None else rows.filter(value <= F.lit(float(hi)))
    return rows.select(*[F.col(f"`{c}`") for c in columns])


def scan_bytes(zones: DataFrame, columns: Sequence[str], ranges: Mapping[str, Range]) -> DataFrame:
    """(column, n_groups, n_kept, bytes_all, bytes_kept) of a scan: what its filter spares."""
    needed = list(dict.fromkeys([*columns, *ranges]))
    marks = marked_groups(zones, ranges)
    chunks = zones.filter(F.col("column").isin(needed)).join(marks.select("path", "row_group", "kept"), ["path", "row_group"])
    return chunks.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if("kept").alias("n_kept"),
        F.sum("bytes").alias("bytes_all"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("bytes"))), F.lit(0)).alias("bytes_kept"),
    )

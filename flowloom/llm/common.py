"""Helpers of the text operators: lineage cuts, tables, and Arrow passes over whole texts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that one call of a batch function gets, unless a single text is longer.
CHUNK_CHARS = 1_000_000

#: Prefix of every column that an operator adds for itself.
OWN = "_fl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that all executors share.

    The folder is the one of ``spark.checkpoint.dir``. Only a local session without that setting
    gets a folder of its own, so a lost executor never takes the only copy along.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(root)
    return df.checkpoint()


def chunks(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``limit`` bytes; every text is in exactly one run."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def source_columns(keep: list[str], text: str) -> list[Column]:
    """Kept columns and the text under names of their own, so that no given name can clash."""
    own = [F.col(f"`{c}`").alias(f"{OWN}keep{i}") for i, c in enumerate(keep)]
    return [*own, F.col(f"`{text}`").cast("string").alias(OWN + "body")]


def map_texts(
    df: DataFrame, text: str, keep: list[str], fields: list[T.StructField],
    make: Callable[[], Callable[..., list[list]]], others: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` as they are, and new ones that a batch function computes from whole texts.

    ``make`` is called once in each task; what it returns takes a list of texts (a null text comes
    as the empty one), and lists of the columns ``others``, and gives one list for each field. Only the named columns are read, so other
    columns may have any names. No row is moved between partitions.
    """
    source = df.select(*source_columns(keep, text), *[F.col(f"`{c}`").alias(f"{OWN}other{i}") for i, c in enumerate(others or [])])
    kept = [T.StructField(c, f.dataType, f.nullable) for c, f in zip(keep, source.schema.fields, strict=False)]
    # A text that is kept anyway goes to Python once.
    at = keep.index(text) if text in keep and dict(df.dtypes).get(text) == "string" else len(keep)
    if at < len(keep):
        source = source.drop(OWN + "body")
    first_other = len(keep) + (at == len(keep))
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [*keep, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for lo, hi in chunks(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(at).to_pylist()]
                more = [part.column(first_other + i).to_pylist() for i in range(len(others or []))]
                new = [pa.array(c, type=k) for c, k in zip(fn(texts, *more), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + new, names=names)

    return source.mapInArrow(run, T.StructType([*kept, *fields]))


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string_field(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())

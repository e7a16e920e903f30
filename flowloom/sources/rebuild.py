"""Feature tables that are rebuilt file by file.

A table has one part for each source file and one manifest for each version: which files it covers, their
fingerprints, and the version in which the part of each was written. A rebuild compares the files
with the manifest by an anti join, writes parts of new and changed files only, then the manifest, and at last
one row with the new version number. Readers follow the highest number, so a rebuild that fails at any
point leaves the last version as it was, and the next one writes over what it left. One rebuild runs at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.bounds import fetched

PART = "_fl_part"
MAX_FILES = 1_000_000  # files of one rebuild and versions in use, whose names the driver holds
_MANIFEST = "uri string, fingerprint string, part string, version long, n_rows long"


@dataclass(frozen=True)
class Rebuilt:
    version: int
    files_built: int
    rows_built: int


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, without rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the last complete version; 0 before the first."""
    return _existing(spark, f"{root}/pointer", "version long").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(uri, fingerprint, part, version, n_rows) of the files that a version covers, the last one by default."""
    at = current_version(spark, root) if version is None else version
    if at == 0:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/at={at}")


def source_files(spark: SparkSession, source: str, settings: str = "", pattern: str = "*.parquet") -> DataFrame:
    """(path, uri, fingerprint, part) of the files below a folder, from their listing alone.

    The fingerprint covers size, time of change and ``settings``: whatever else decides the features,
    such as a hash of the scaler.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(source)
    )
    uri = F.col("_metadata.file_path")
    marks = F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"), F.lit(settings))
    return listed.select("path", uri.alias("uri"), F.sha2(marks, 256).alias("fingerprint"), _part(uri).alias("part"))


def _part(uri: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(F.sha2(uri, 256), 1, 32))


def rebuild(spark: SparkSession, source: str, root: str, build: Callable[[DataFrame], DataFrame], settings: str = "",
            pattern: str = "*.parquet") -> Rebuilt:
    """Bring the table below ``root`` up to the files below ``source``.

    ``build`` turns rows of the source into feature rows, row by row, and passes the column ``PART`` through.
    Parts of files that did not change stay as they are; those of files that are gone leave the table. Where
    nothing changed there is no new version.
    """
    last = current_version(spark, root)
    old = manifest(spark, root, last)
    files = source_files(spark, source, settings, pattern)
    same = files.join(old.select("uri", "fingerprint", "version", "n_rows"), ["uri", "fingerprint"])
    changed = files.join(old.select("uri", "fingerprint"), ["uri", "fingerprint"], "left_anti")
    fresh = fetched(changed.select("path", "uri", "fingerprint", "part"), "changed files", MAX_FILES)
    gone = old.join(files.select("uri"), "uri", "left_anti")
    if not fresh.num_rows and gone.isEmpty():
        return Rebuilt(last, 0, 0)
    version = last + 1
    staged = f"{root}/data/at={version}"
    kept = same.select("uri", "fingerprint", "part", "version", "n_rows")
    n = 0
    if fresh.num_rows:
        rows = spark.read.parquet(*fresh.column("path").to_pylist())
        out = build(rows.withColumn(PART, _part(F.col("_metadata.file_path"))))
        if PART not in out.columns:
            raise ValueError(f"build must pass the column {PART} through")
        seen = Observation()
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(PART).parquet(staged)
        n = seen.get["n"]
        counts = spark.read.schema(out.schema).parquet(staged).groupBy(F.col(PART).alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
        built = spark.createDataFrame(fresh).select("uri", "fingerprint", "part", F.lit(version).cast("long").alias("version"))
        built = built.join(counts, "part", "left").select("uri", "fingerprint", "part", "version", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        kept = kept.unionByName(built)
    path = f"{root}/manifest/at={version}"
    kept.write.mode("overwrite").parquet(path)
    found = manifest(spark, root, version).filter(F.col("version") == version).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    if found != n:
        raise RuntimeError(f"{staged}: wrote {n} rows, found {found}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return Rebuilt(version, fresh.num_rows, n)


def read_features(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows of a version, the last one by default, with the ``built_at`` version of their part.

    Only folders of versions still in use are listed. Within them parts that a later version replaced are left out
    by their partition values, which a manifest small enough to be broadcast prunes before they are opened.
    """
    have = manifest(spark, root, version)
    used = fetched(have.filter("n_rows > 0").select("version").distinct(), "versions", MAX_FILES).column(0).to_pylist()
    if not used:
        raise ValueError(f"{root} has no rows")
    rows = spark.read.option("basePath", f"{root}/data").parquet(*[f"{root}/data/at={v}" for v in sorted(used)])
    live = have.select(F.col("part").alias(PART), F.col("version").alias("at"))
    rows = rows.withColumn("at", F.col("at").cast("long"))
    return rows.join(live, [PART, "at"], "left_semi").withColumnRenamed("at", "built_at").drop(PART)

"""Corpus pipeline: good documents, one of each near-duplicate group, no test items, no secrets, packed.

Each stage takes all documents that the one before it kept and decides on whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontam, packing, quality, secrets, simhash
from flowloom.llm.common import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; a rejected document goes."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=docs.columns, name="_fl_score")
    return scored.where(F.col("_fl_score") >= quality.KEEP_FROM).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id."""
    return simhash.one_of_each(docs).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    found = decontam.leaks_of(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns, name="_fl_found")
    return found.where(F.size("_fl_found") == 0).select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a secret in a text is replaced by its kind in brackets, and the length follows."""
    rest = [c for c in docs.columns if c != "text"]
    masked = secrets.mask_secrets(docs, keep=rest)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of one capacity with the pieces of every document."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret scans", hide_secrets),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

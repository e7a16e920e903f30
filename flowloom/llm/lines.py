"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions alone.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
``MIN_CHARS`` code points count. A run is a bucketed, sorted table of key hashes (128 bits) with the
document that keeps the key; its keys are in no other run. A batch of documents reduces its keys to
one row each by partial sums, anti-joins them with every run bucket by bucket, so that runs are merged
without being shuffled, and adds what is left as a run of level 0. ``FAN`` runs of one level are
compacted to one of the next, so the number of runs grows with the logarithm of the batches.

Batches ascend by document id, so the first one that holds a key holds its smallest document. A line is
dropped if (key, document) is in no run. That test is an anti-join on key and document together:
a line that a third of all documents share is spread over all tasks. Texts are read once for the hashes
and once for the result, where the positions of dropped lines, sorted, meet their text.

Null and empty texts are one empty line. A null id is a document of its own, larger than any other. Rows
that repeat an id are one document: its lines never drop each other. Ids that are not numbers make a
single batch. An empty table gives an empty result. Columns that are not named are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import OWN, cut
from flowloom.session import shared_dir

#: Code points of the shortest key that counts.
MIN_CHARS = 10
#: White space that is stripped from a line's ends; a fixed value.
BLANK = " \t\n\x0b\x0c\r"
#: Batches of a whole table, and runs of a level that are compacted to one.
BATCHES, FAN = 6, 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH = ["_fl_h1", "_fl_h2"]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are; the short way for texts of ASCII alone."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_hashes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(``_fl_id``, ``_fl_mark``, ``_fl_pos``, ``_fl_h1``, ``_fl_h2``) of every line whose key counts.

    ``_fl_mark`` tells texts of one id apart; ``_fl_pos`` is the number of the line in its text.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = df.select(
        F.col(f"`{doc_id}`").alias("_fl_id"), F.xxhash64(body).alias("_fl_mark"),
        F.posexplode(F.split(ascii_lower(body), "\n", -1)).alias("_fl_pos", "_fl_line"),
    ).withColumn("_fl_key", F.btrim("_fl_line", F.lit(BLANK)))
    return lines.where(F.length("_fl_key") >= min_chars).select(
        "_fl_id", "_fl_mark", "_fl_pos", F.xxhash64("_fl_key").alias("_fl_h1"), F.xxhash64(F.lit(1), "_fl_key").alias("_fl_h2")
    )


class LineRuns:
    """Levels of disjoint sorted runs in the shared folder; a run is a bucketed table of the session."""

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        if fan < 2:
            raise ValueError("a compaction takes two runs at least")
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = shared_dir(spark, "line-runs")
        self.levels: list[list[str]] = [[]]

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def write(self, keys: DataFrame) -> str:
        name = f"fl_run_{uuid.uuid4().hex}"
        out = keys.write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH)
        out.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        """``keys`` (one row each, by their hash) that no run holds."""
        return reduce(lambda left, name: left.join(self.spark.table(name), HASH, "left_anti"), self.names(), keys)

    def add(self, lines: DataFrame) -> DataFrame:
        """The run of keys that are new with this batch, each with the smallest document of the batch."""
        keys = lines.groupBy(*HASH).agg(F.min("_fl_id").alias("_fl_id"))
        name = self.write(self.unseen(keys))
        self.levels[0].append(name)
        added = self.spark.table(name)
        self.compact()
        return added

    def compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fan:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            runs = reduce(DataFrame.unionAll, [self.spark.table(name) for name in old])
            self.levels[level + 1].append(self.write(runs.repartition(self.buckets, *HASH)))
            self.forget(old)
            level += 1

    def forget(self, names: list[str]) -> None:
        """Drop tables from the session; files stay, as frames that were handed out may read them, and go with the shared folder."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def all(self) -> DataFrame:
        """(``_fl_h1``, ``_fl_h2``, ``_fl_id``): every key once, with the document that keeps it."""
        return reduce(DataFrame.unionAll, [self.spark.table(name) for name in self.names()])

    def close(self) -> None:
        self.forget(self.names())
        self.levels = [[]]


def batch_of(df: DataFrame, doc_id: str, batches: int) -> Column:
    """Number of the batch, ascending by ``_fl_id``; the last one takes null ids."""
    if not isinstance(df.schema[doc_id].dataType, T.NumericType) or batches < 2:
        return F.lit(0)
    at = F.percentile_approx(F.col(f"`{doc_id}`"), [i / batches for i in range(1, batches)], 10_000)
    bounds = df.agg(at.alias("at")).first()["at"] or []  # batches - 1 numbers
    above = [F.when(F.col("_fl_id") <= F.lit(b), 0).otherwise(1) for b in bounds]
    return reduce(Column.__add__, above, F.lit(0))


def dropped_lines(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, batches: int = BATCHES, fan: int = FAN,
) -> DataFrame:
    """(``_fl_id``, ``_fl_mark``, ``_fl_drop``): ascending line numbers of the lines that go, for texts that lose some."""
    spark = df.sparkSession
    hashed = line_hashes(df, text, doc_id, min_chars).withColumn("_fl_batch", batch_of(df, doc_id, batches))
    # Written once, rows of a batch next to each other, so that a batch skips the pages of the others.
    path = shared_dir(spark, "line-hashes")
    hashed.sortWithinPartitions("_fl_batch").write.parquet(path)
    lines = spark.read.schema(hashed.schema).parquet(path)
    runs = LineRuns(spark, fan)
    for batch in range(batches):
        runs.add(lines.where(F.col("_fl_batch") == batch))
    kept = runs.all()
    same = [lines[h] == kept[h] for h in HASH] + [lines["_fl_id"].eqNullSafe(kept["_fl_id"])]
    gone = lines.join(kept, same, "left_anti").groupBy("_fl_id", "_fl_mark")
    out = cut(gone.agg(F.sort_array(F.collect_set("_fl_pos")).alias("_fl_drop")))
    runs.close()
    return out


def without_lines(lines: Column, drop: Column) -> Column:
    """The lines joined again but for those numbered in ``drop``, in time linear in both."""
    gaps = F.transform(drop, lambda x, i: x - F.when(i == 0, F.lit(-1)).otherwise(F.get(drop, i - 1)) - 1)
    marks = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))
    marks = F.concat(marks, F.array_repeat(F.lit(False), F.size(lines) - 1 - F.element_at(drop, -1)))
    return F.array_join(F.zip_with(lines, marks, lambda line, gone: F.when(~gone, line)), "\n")


def dedup_lines(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None,
    min_chars: int = MIN_CHARS, batches: int = BATCHES, fan: int = FAN,
) -> DataFrame:
    """``keep``, ``n_lines`` (before), ``n_dropped`` and ``kept``, the text without the dropped lines, of every row."""
    kept = keep or [doc_id]
    own = [f"{OWN}k{i}" for i in range(len(kept))]
    gone = dropped_lines(df, text, doc_id, min_chars, batches, fan)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    docs = df.select(
        *[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)],
        F.col(f"`{doc_id}`").alias("_fl_doc"), F.xxhash64(body).alias("_fl_text_mark"), body.alias("_fl_body"),
    )
    same = docs["_fl_doc"].eqNullSafe(gone["_fl_id"]) & (docs["_fl_text_mark"] == gone["_fl_mark"])
    split = docs.join(gone, same, "left").withColumn("_fl_lines", F.split("_fl_body", "\n", -1))
    text_left = F.when(F.col("_fl_drop").isNull(), F.col("_fl_body")).otherwise(without_lines(F.col("_fl_lines"), F.col("_fl_drop")))
    return split.select(
        *[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)],
        F.size("_fl_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_fl_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        text_left.alias("kept"),
    )

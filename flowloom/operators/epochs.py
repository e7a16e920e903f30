"""Epochs of full batches without moving a row: a keyed bijection on dense row numbers.

A row's number is the count of rows in the files before its own, by path, plus its place in the file:
it depends neither on splits nor on tasks. A Feistel network on a x b cells (a the root of the row count,
rounded up) maps numbers to places of the epoch; a number that lands beyond the rows is mapped again until it
does not, which can happen to less than about a of them. How often at most is known from those few, so
the plan holds that many steps. Rows stay where they are; only counts of files are aggregated.
"""

from __future__ import annotations

from hashlib import md5
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.bounds import fetched

#: Modulus of the round function, whose squares fit a long, and number of rounds.
PRIME, ROUNDS = 2**31 - 1, 6
MOST_FILES = 500_000
MOST_ROWS = 2**60


def dense_numbers(spark: SparkSession, path: str, out: str = "number", pattern: str = "*.parquet") -> tuple[DataFrame, int]:
    """Rows of a Parquet folder with their numbers from 0, and how many there are."""
    rows = spark.read.option("pathGlobFilter", pattern).parquet(path)
    counts = rows.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("n"))
    files = sorted((r["_file"], r["n"]) for r in fetched(counts, "files", MOST_FILES).to_pylist())
    before = np.cumsum([0, *(n for _, n in files)]).tolist()
    first = spark.createDataFrame([(name, at) for (name, _), at in zip(files, before)], "_file string, _before long")
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    # One row for each file, bounded above.
    placed = placed.join(F.broadcast(first), "_file").withColumn(out, F.col("_before") + F.col("_index"))
    return placed.drop("_file", "_before", "_index"), before[-1]


def round_keys(seed: int | str, epoch: int) -> list[tuple[int, int]]:
    """Factor and summand of each round."""
    digests = [md5(f"{seed}|{epoch}|{i}".encode()).hexdigest() for i in range(ROUNDS)]
    return [(1 + int(d[:12], 16) % (PRIME - 1), int(d[12:24], 16) % PRIME) for d in digests]


def sides(n: int) -> tuple[int, int]:
    """Cells a x b of the network: no fewer than ``n``, and fewer than ``n`` + a."""
    a = isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def permuted(x: np.ndarray, n: int, keys: list[tuple[int, int]]) -> np.ndarray:
    """One pass of the network over cell numbers; a bijection of the a x b cells."""
    a, b = sides(n)
    left, right = x // b, x % b
    for i, (factor, summand) in enumerate(keys):
        z = ((right if i % 2 == 0 else left) + summand) % PRIME
        z = z * z % PRIME * factor % PRIME
        if i % 2 == 0:
            left = (left + z) % a
        else:
            right = (right + z) % b
    return left * b + right


def most_passes(n: int, keys: list[tuple[int, int]]) -> int:
    """Passes after which every row number is among the rows again: one, and the longest way through the cells beyond."""
    a, b = sides(n)
    beyond = np.arange(n, a * b, dtype=np.int64)
    longest = 0
    for step in range(1, len(beyond) + 1):
        beyond = permuted(beyond, n, keys)
        if (beyond < n).any():
            longest = step
        beyond = beyond[beyond >= n]
        if not len(beyond):
            break
    return 1 + longest


def epoch_place(number: Column, n: int, seed: int | str, epoch: int) -> Column:
    """Place in the epoch of each row number below ``n``."""
    if n > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    a, b = (F.lit(v).cast("long") for v in sides(n))
    keys = round_keys(seed, epoch)
    rounds = F.array(*[F.struct(F.lit(i % 2 == 0).alias("even"), F.lit(f).cast("long").alias("f"), F.lit(s).cast("long").alias("s")) for i, (f, s) in enumerate(keys)])

    def one(s: Column, k: Column) -> Column:
        z = (F.when(k["even"], s["r"]).otherwise(s["l"]) + k["s"]) % PRIME
        z = z * z % PRIME * k["f"] % PRIME
        return F.struct(F.when(k["even"], (s["l"] + z) % a).otherwise(s["l"]).alias("l"), F.when(k["even"], s["r"]).otherwise((s["r"] + z) % b).alias("r"))

    def through(x: Column) -> Column:
        return F.aggregate(rounds, F.struct(F.call_function("div", x, b).alias("l"), (x % b).alias("r")), one, lambda s: s["l"] * b + s["r"])

    walk = F.sequence(F.lit(1), F.lit(most_passes(n, keys)))
    return F.aggregate(walk, number.cast("long"), lambda x, i: F.when((i > 1) & (x < n), x).otherwise(through(x)))


def batches_in_place(rows: DataFrame, n: int, batch_size: int, epoch: int, seed: int | str = 42, number: str = "number", drop_last: bool = False) -> DataFrame:
    """``rows`` with ``batch_id`` and ``position`` of one epoch; every batch but the last is full."""
    at = rows.withColumn("_place", epoch_place(F.col(number), n, seed, epoch))
    out = at.select(*rows.columns, F.call_function("div", F.col("_place"), F.lit(batch_size)).alias("batch_id"), (F.col("_place") % batch_size).alias("position"))
    return out.filter(F.col("batch_id") < n // batch_size) if drop_last else out

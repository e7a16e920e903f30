"""Exact ranks in hash order without sorting the data as a whole.

Rows are ordered by md5(seed | key) inside a group. The first hex digits of that hash form
order-preserving buckets of equal expected size, so a counted histogram says in which bucket a
rank falls, however many rows a group holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.text import seeded_hash
from flowloom.operators.bounds import MAX_CLASSES, bounded, fetched, labelled, pinned, small

BUCKET_DIGITS = 4  # 65,536 buckets per group when every row needs its rank
CUT_DIGITS = 3  # 4,096 buckets per group and level when only some ranks are wanted
RANK_ROWS = 2_000_000  # rows of one bucket that one task may sort
HASH_DIGITS = 32


def _edges(hist: DataFrame, group: list[str], lims: Column) -> DataFrame:
    """Buckets in which a wanted rank falls, with the rank inside the bucket.

    ``hist`` has bucket counts _c and columns the ranks ``lims`` are computed from.
    """
    in_group = Window.partitionBy(*group)
    cum = hist.select(
        "*",
        F.sum("_c").over(in_group.orderBy("_b")).alias("_upto"),
        F.sum("_c").over(in_group).alias("_n"),
    ).withColumn("_lims", lims)
    return (
        cum.select("*", F.posexplode("_lims").alias("_i", "_lim"))
        .filter((F.col("_lim") > F.col("_upto") - F.col("_c")) & (F.col("_lim") <= F.col("_upto")))
        .withColumn("_at", F.col("_lim") - F.col("_upto") + F.col("_c"))
    )


def hash_cuts(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str,
    limits: Callable[[Column], Sequence[Column]] | None = None,
    group: str | None = None,
    limit_table: DataFrame | None = None,
    digits: int = CUT_DIGITS,
    rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """Per group, the hash of the row at each wanted rank: (_g, _t0, _t1, ...), computed at once.

    ``limits`` maps the group size to ascending ranks; ``limit_table`` (_g, _lims) gives one rank
    per group directly. A rank of 0 yields NULL. Rows at or before a rank are then found by
    comparing hashes, which needs no shuffle of the rows themselves.

    The rank is narrowed down by histograms over ever longer hash prefixes until the bucket that
    holds it has at most ``rank_rows`` rows; only those are sorted. Keys that repeat at a cut, where
    they would change the number of rows on its sides, fail the query.
    """
    keys = [key] if isinstance(key, str) else list(key)
    g = F.col(group) if group else F.lit(0)
    hashed = df.select(g.alias("_g"), seeded_hash(seed, *keys).alias("_h"))
    count = F.count(F.lit(1)).alias("_c")
    length = digits
    hist = hashed.groupBy("_g", F.substring("_h", 1, length).alias("_b")).agg(count)
    if group:
        hist = labelled(hist, "_g", group)
    if limit_table is None:
        lims = F.array(*[x.cast("long") for x in limits(F.col("_n"))])
        n_cuts = len(limits(F.col("_n")))
    else:
        hist = hist.join(small(limit_table, "rank limits"), "_g")
        lims, n_cuts = F.col("_lims"), 1
    what, most = "groups of a ranked draw", n_cuts * MAX_CLASSES
    wanted = ["_g", "_j", "_b", "_at", "_c"]
    first = _edges(hist, ["_g"], lims).withColumnRenamed("_i", "_j").select(wanted)
    found_at = fetched(first, what, most)
    edges = df.sparkSession.createDataFrame(found_at, schema=first.schema)
    while max(found_at.column("_c").to_pylist(), default=0) > rank_rows:
        if length >= HASH_DIGITS:
            raise ValueError(f"keys {keys} are not unique")
        inside = hashed.withColumn("_b", F.substring("_h", 1, length)).join(
            F.broadcast(edges.drop("_c")), ["_g", "_b"]
        )
        length = min(length + digits, HASH_DIGITS)
        hist = inside.groupBy("_g", "_j", "_at", F.substring("_h", 1, length).alias("_b")).agg(count)
        finer = _edges(hist.withColumnRenamed("_at", "_want"), ["_g", "_j"], F.array("_want"))
        found_at = fetched(finer.select(wanted), what, most)
        edges = df.sparkSession.createDataFrame(found_at, schema=first.schema)
    ordered = Window.partitionBy("_g", "_b", "_j").orderBy("_h")
    found = (
        hashed.withColumn("_b", F.substring("_h", 1, length))
        .join(F.broadcast(edges.drop("_c")), ["_g", "_b"])
        .withColumns({"_rn": F.row_number().over(ordered), "_next": F.lead("_h").over(ordered)})
        .filter(F.col("_rn") == F.col("_at"))
    )
    # Rows at or before the cut number exactly the wanted rank only if the next row has another hash.
    repeats = F.raise_error(F.lit(f"keys {keys} are not unique"))
    found = found.withColumn("_h", F.when(F.col("_next") == F.col("_h"), repeats).otherwise(F.col("_h")))
    picks = [F.max(F.when(F.col("_j") == j, F.col("_h"))).alias(f"_t{j}") for j in range(n_cuts)]
    return pinned(found.groupBy("_g").agg(*picks), what)


def part_by_cuts(
    df: DataFrame,
    cuts: DataFrame,
    key: str | Sequence[str],
    seed: int | str,
    names: Sequence[str],
    group: str | None = None,
    out: str = "split",
) -> DataFrame:
    """Label rows by the first cut that contains them; the last name takes the rest.

    ``cuts`` is a pinned table of one row per group and is broadcast; the rows are not moved.
    """
    keys = [key] if isinstance(key, str) else list(key)
    drop = ["_h"]
    if group:
        joined = df.join(F.broadcast(cuts), F.col(group) == F.col("_g"), "left")
        at = [F.col(f"_t{j}") for j in range(len(names) - 1)]
        drop += ["_g", *[f"_t{j}" for j in range(len(names) - 1)]]
    else:
        joined, row = df, cuts.first()  # a single row
        at = [F.lit(row[f"_t{j}"] if row else None).cast("string") for j in range(len(names) - 1)]
    label: Column | None = None
    for t, name in zip(at, names):
        cond = F.coalesce(F.col("_h") <= t, F.lit(False))
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    assert label is not None
    # the hash is a column of its own, so that it is computed once however many cuts there are
    hashed = joined.withColumn("_h", seeded_hash(seed, *keys))
    return hashed.withColumn(out, label.otherwise(F.lit(names[-1]))).drop(*drop)


def hash_rank(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str,
    group: str | Sequence[str] | None = None,
    digits: int = BUCKET_DIGITS,
    out: str = "rank",
    order_hash: Column | None = None,
) -> DataFrame:
    """1-based rank of every row inside its group, in hash order.

    The rows are shuffled once, by (group, bucket), so a group of any size is spread over as
    many tasks as it has buckets.
    """
    keys = [key] if isinstance(key, str) else list(key)
    groups = [group] if isinstance(group, str) else list(group or [])
    h = order_hash if order_hash is not None else seeded_hash(seed, *keys)
    rows = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))
    hist = rows.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(
        Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = hist.select(*groups, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    if not groups:
        offsets = F.broadcast(bounded(offsets, 16**digits, "hash buckets"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", *keys))
    return (
        rows.join(offsets, [*groups, "_b"])
        .withColumn(out, F.col("_before") + inside)
        .drop("_h", "_b", "_before")
    )

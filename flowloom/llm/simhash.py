"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has a bit set if over half of the 64-bit hashes of the text's word shingles have it set.
Two fingerprints link at ``MAX_BITS`` or fewer differing bits, and linked documents form components.

Distinct fingerprints are dealt out by blocks of bits: of six blocks, at most four can differ, so two
linked fingerprints agree on two whole blocks and meet under that pair of blocks. Within such a group
the fingerprints are sorted by Gray rank, so that neighbours differ in few bits, and cut into leaves; a
node keeps the bits that all below it share (a mask and a pattern), an upper node those its children
share. A search goes down level by level for all queries at once, sums the differences on bits that
become fixed on the way, and leaves a node as soon as the sum exceeds the limit. A group that outgrows
``GROUP`` is cut into sections by hash, and every pair of sections is a group of its own, so that
no task holds more than two sections. Links leave a group as a forest.

Null and empty texts have fingerprint zero and link like others. Rows that repeat have one fingerprint
and one component. Documents with a null id take part and do not name a component unless all do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom.llm.common import cut, long_field, map_texts

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Blocks of bits; MAX_BITS differences leave at least two of six blocks equal.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
GROUP = 4096
LEAF, FAN = 8, 8
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of a text."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lens)
        starts = (ends - lens)[: len(words) - SHINGLE + 1].tolist()
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65_536):
        ones += np.unpackbits(h[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(BITS[2 * ones > len(h)].sum())


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def with_fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and ``_fl_fp``, the fingerprint as a signed long."""
    def make() -> Callable[[list[str]], list[list]]:
        return lambda texts: [[signed(fingerprint(t)) for t in texts]]

    return map_texts(df, text, keep or ["doc_id"], [long_field("_fl_fp")], make)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence: the inverse of x ^ (x >> 1)."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of (mask, pattern) nodes over fingerprints in Gray order; the last level is the fingerprints."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        full = np.uint64(2**64 - 1)
        mask, pattern = np.full(len(values), full), self.values
        levels = [(mask, pattern, 1)]
        fan = LEAF
        while len(mask) > FAN:
            at = np.arange(0, len(mask), fan)
            both = np.bitwise_and.reduceat(pattern & mask, at)
            none = np.bitwise_and.reduceat(~pattern & mask, at)
            mask = both | none
            pattern = both
            levels.append((mask, pattern, fan))
            fan = FAN
        self.levels = levels[::-1]

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query position, value position) within ``limit`` differing bits."""
        mask, pattern, _ = self.levels[0]
        q = np.repeat(np.arange(len(queries)), len(mask))
        node = np.tile(np.arange(len(mask)), len(queries))
        spent = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node]).astype(np.int64)
        for depth in range(1, len(self.levels)):
            keep = spent <= limit
            q, node, spent = q[keep], node[keep], spent[keep]
            upper = self.levels[depth - 1]
            fan = upper[2]
            mask, pattern, _ = self.levels[depth]
            child = (node[:, None] * fan + np.arange(fan)).ravel()
            fits = child < len(mask)
            parent_mask = np.repeat(upper[0][node], fan)[fits]
            q, spent, child = np.repeat(q, fan)[fits], np.repeat(spent, fan)[fits], child[fits]
            # Bits fixed at an upper node are already counted; only those that are new here are added.
            spent = spent + np.bitwise_count((queries[q] ^ pattern[child]) & mask[child] & ~parent_mask)
            node = child
        keep = spent <= limit
        return q[keep], self.order[node[keep]]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(values: np.ndarray, sections: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the group's links connect: (value, smallest position's value).

    A group of two sections searches the one with the other; links inside a section are found where
    the section meets itself.
    """
    first = sections == sections.min()
    two = not first.all()
    inside, asks = (np.flatnonzero(first), np.flatnonzero(~first)) if two else (np.arange(len(values)),) * 2
    index = GrayIndex(values[inside])
    pairs = []
    for lo in range(0, len(asks), 512):
        q, v = index.search(values[asks[lo : lo + 512]], limit)
        pairs.append((asks[lo + q], inside[v]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    root = roots(len(values), a, b)
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def links(fingerprints: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """(``_fl_a``, ``_fl_b``): links between distinct fingerprints whose components are those of all links.

    ``fingerprints`` has one row for each distinct ``_fl_fp``.
    """
    keys = [F.lit(i).cast("long") * (1 << 22) + block(a) * (1 << 11) + block(b) for i, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))]
    dealt = fingerprints.select("_fl_fp", F.explode(F.array(*keys)).alias("_fl_key"))
    # Keys are bounded (15 x 2^22); those with more than GROUP fingerprints are cut into sections.
    large = dealt.groupBy("_fl_key").count().where(F.col("count") > GROUP)
    cuts = large.select("_fl_key", F.ceil(F.col("count") / GROUP).cast("int").alias("_fl_cuts"))
    spread = dealt.join(cuts, "_fl_key", "left").withColumn("_fl_cuts", F.coalesce("_fl_cuts", F.lit(1)))
    section = F.when(F.col("_fl_cuts") == 1, 0).otherwise(F.pmod(F.xxhash64("_fl_fp"), F.col("_fl_cuts"))).cast("int")
    spread = spread.withColumn("_fl_section", section)
    other = F.sequence(F.lit(0), F.col("_fl_cuts") - 1)
    grouped = spread.select("_fl_fp", "_fl_key", "_fl_section", F.explode(other).alias("_fl_other")).select(
        "_fl_fp", "_fl_section", "_fl_key",
        F.least("_fl_section", "_fl_other").alias("_fl_low"), F.greatest("_fl_section", "_fl_other").alias("_fl_high"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; groups of a batch are complete except the last, which is carried on."""
        def close(pdf: pd.DataFrame) -> pd.DataFrame:
            v, r = linked(pdf, limit)
            return pd.DataFrame({"_fl_a": v.view(np.int64), "_fl_b": r.view(np.int64)})

        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf[GROUP_KEY].to_numpy()
            changes = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if rest and (rest[-1][GROUP_KEY].to_numpy()[-1] != key[0]).any():
                yield close(pd.concat(rest))
                rest = []
            if len(changes):
                yield close(pd.concat([*rest, pdf.iloc[: changes[-1]]]))
                rest = []
            rest.append(pdf.iloc[changes[-1] if len(changes) else 0 :])
        if rest:
            yield close(pd.concat(rest))

    ordered = grouped.repartition(*GROUP_KEY).sortWithinPartitions(*GROUP_KEY, "_fl_fp")
    return ordered.mapInPandas(run, "_fl_a long, _fl_b long")


GROUP_KEY = ["_fl_key", "_fl_low", "_fl_high"]


def linked(pdf: pd.DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Forests of all groups of a sorted frame; small groups share one index, their key counts as bits."""
    key = pdf[GROUP_KEY].to_numpy()
    fp = pdf["_fl_fp"].to_numpy().astype(np.int64).view(np.uint64)
    section = pdf["_fl_section"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(key)])
    out_a, out_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if size == 2:
            x, y = fp[start], fp[start + 1]
            if np.bitwise_count(x ^ y) <= limit:
                out_a.append(fp[start + 1 : start + 2])
                out_b.append(fp[start : start + 1])
        elif size > 2:
            a, b = forest(fp[start : start + size], section[start : start + size], limit)
            out_a.append(a)
            out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def block(i: int):
    """Block i of the fingerprint's bits as a column."""
    start, width = BLOCKS[i]
    return F.shiftrightunsigned("_fl_fp", start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def components(edges: DataFrame) -> DataFrame:
    """(``_fl_fp``, ``_fl_root``): the smallest fingerprint reachable, for fingerprints with a link.

    Large-star and small-star steps until every vertex has one neighbour and no hub has a hub; both
    shorten paths, so the number of rounds grows with the logarithm of the longest path. A star's hub is
    the smallest of its neighbours.
    """
    edges = cut(edges.select(F.greatest("_fl_a", "_fl_b").alias("u"), F.least("_fl_a", "_fl_b").alias("v")).where("u <> v").distinct())
    while not are_stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: each vertex hands its smaller neighbours, and itself, to the smallest of them.
        hub = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hub, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(hub.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
    return edges.select(F.col("u").alias("_fl_fp"), F.col("v").alias("_fl_root"))


def are_stars(edges: DataFrame) -> bool:
    """Whether each vertex u has one edge (u, v), and no v is a u itself."""
    one, none = F.lit(1).alias("c"), F.lit(0).alias("c")
    ends = edges.select(F.col("u").alias("x"), one, F.lit(0).alias("h")).unionAll(edges.select(F.col("v").alias("x"), none, F.lit(1).alias("h")))
    seen = ends.groupBy("x").agg(F.sum("c").alias("c"), F.max("h").alias("h"))
    return not seen.where("c > 1 or c = 1 and h = 1").head(1)


def classes(df: DataFrame, text: str = "text", keep: list[str] | None = None, limit: int = MAX_BITS) -> DataFrame:
    """``keep``, ``_fl_fp`` and ``_fl_root``, the smallest fingerprint of the component, of every row."""
    docs = cut(with_fingerprints(df, text, keep or ["doc_id"]))
    heads = cut(docs.select("_fl_fp").distinct())
    rooted = components(links(heads, limit))
    return docs.join(rooted, "_fl_fp", "left").withColumn("_fl_root", F.coalesce("_fl_root", "_fl_fp"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row."""
    rows = classes(df, text, [doc_id], limit)
    # One row for each component, from partial sums; hot components meet it in a join that adaptive execution splits.
    named = rows.groupBy("_fl_root").agg(F.min(f"`{doc_id}`").alias("component_id"))
    return rows.join(named, "_fl_root").select(
        f"`{doc_id}`", F.lower(F.lpad(F.hex("_fl_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest id, once."""
    i, none = F.col(f"`{doc_id}`"), F.lit("")
    marked = df.withColumn("_fl_mark", F.xxhash64(F.coalesce(F.col(f"`{text}`"), none)))
    row = F.struct(i.alias("i"), F.col("_fl_mark").alias("m"))
    first = classes(marked, text, [doc_id, "_fl_mark"], limit).groupBy("_fl_root").agg(F.min(row).alias("r"))

    def key(i: Column, m: Column) -> Column:
        return F.concat_ws(":", F.coalesce(i.cast("string"), none), i.isNull().cast("string"), m.cast("string"))

    # Id and mark are one column, so that the texts cross one shuffle for the join and the window.
    kept = first.select(key(F.col("r.i"), F.col("r.m")).alias("_fl_key"))
    again = W.partitionBy("_fl_key").orderBy("_fl_key")
    left = marked.withColumn("_fl_key", key(i, F.col("_fl_mark"))).join(kept, "_fl_key", "left_semi")
    return left.withColumn("_fl_again", F.row_number().over(again)).where("_fl_again = 1").select(*[F.col(f"`{c}`") for c in df.columns])

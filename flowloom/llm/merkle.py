"""Merkle manifest of a dataset: a tree for each group, a tree over the groups, and a proof for each row.

Rows of a group ascend by key; ``FANOUT`` consecutive nodes become the digest of their concatenated
digests until one is left. A group of rows is cut into aligned blocks of ``FANOUT ** LEVELS`` leaves,
which a task hashes to a block root. Then blocks exchange roots in rounds, as in a butterfly: in round r
the blocks that differ only in digit r of their number meet, each with the digest of its own ancestor,
and each of them hashes the common parent for itself. After the last round every block holds all upper
siblings of its proof and the root; nothing is handed down the tree. In the last, shorter run of a level
a node has fewer blocks than its siblings; its blocks then answer for several places each, in turn.
The roots of the groups are ranked and exchanged in the same way.

Ranks come from ranges of (group, key), counted for each range and group, so that a group with a third of
all rows is spread over as many ranges as its size asks for; rows that are equal in all of that are told
apart by a number of their own. Only keys and digests are moved, never texts, and a task holds the leaves
of a few blocks and one proof for each of them.

A null group comes first, then groups by their bytes; null keys come first in their group. A row that
repeats is a leaf of its own. Null fields hash as ``-``. A group of one row has its leaf as root, a
table of one group that group's root. An empty table gives an empty result. Columns that are not named
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom.llm.common import cut

FANOUT = 3
#: Levels that a task hashes by itself: a block has FANOUT ** LEVELS leaves at most.
LEVELS = 7
#: A level of a proof: the node's place among its siblings, and their digests one behind the other.
PROOF = "array<struct<place:int,siblings:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    d = 0
    while n > 1:
        n, d = -(-n // FANOUT), d + 1
    return d


def leaf_digest(fields: list[Column]) -> Column:
    """Hex digest of the fields: each ``-`` if null, else its length in bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``_fl_index`` (from 0) and ``_fl_size`` within ``_fl_tree``, and the block of the index.

    ``nodes`` is a written table; ``order`` must tell all rows of a tree apart.
    """
    sort = ["_fl_tree", *order]
    # A place is (range, number in the range); the written table keeps both.
    ranges = cut(nodes.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_fl_at", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("_fl_range", F.shiftright("_fl_at", 33))
    spans = ranges.groupBy("_fl_tree", "_fl_range").agg(F.min("_fl_at").alias("_fl_first"), F.count(F.lit(1)).alias("_fl_n"))
    tree = W.partitionBy("_fl_tree")
    before = F.coalesce(F.sum("_fl_n").over(tree.orderBy("_fl_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = spans.select("_fl_tree", "_fl_range", (before - F.col("_fl_first")).alias("_fl_shift"), F.sum("_fl_n").over(tree).alias("_fl_size"))
    rows = ranges.join(shifts, ["_fl_tree", "_fl_range"]).withColumn("_fl_index", F.col("_fl_at") + F.col("_fl_shift"))
    return rows.drop("_fl_range", "_fl_at", "_fl_shift")


def in_cells(rows: DataFrame, block: Column, cells: int) -> DataFrame:
    """A cell takes a few blocks, small trees together, so that a task's group is neither tiny nor large."""
    rows = rows.withColumn("_fl_block", block)
    return rows.withColumn("_fl_cell", F.pmod(F.xxhash64("_fl_tree", "_fl_block"), F.lit(cells)))


def levels_of(hashes: list[str], size: int, levels: int) -> list[list[str]]:
    """Levels of a block from its leaves up; a tree of ``size`` leaves ends where one node is left."""
    out = [hashes]
    for _ in range(min(levels, depth(size))):
        last = out[-1]
        out.append([digest("".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return out


def blocks_of(pdf: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    ordered = pdf.sort_values(["_fl_tree", "_fl_block", "_fl_index"])
    yield from ordered.groupby(["_fl_tree", "_fl_block"], sort=False)


def block_roots(leaves: DataFrame, levels: int) -> DataFrame:
    """(``_fl_tree``, ``_fl_block``, ``_fl_blocks``, ``_fl_hash``, ``_fl_proof``) of every block, with no upper proof yet."""
    width = FANOUT**levels

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (tree, block), part in blocks_of(pdf):
            size = int(part["_fl_size"].iloc[0])
            top = levels_of(part["_fl_hash"].tolist(), size, levels)[-1]
            rows.append((tree, block, -(-size // width), top[0]))
        return pd.DataFrame(rows, columns=["_fl_tree", "_fl_block", "_fl_blocks", "_fl_hash"])

    cells = leaves.select("_fl_cell", "_fl_tree", "_fl_block", "_fl_index", "_fl_size", "_fl_hash").groupBy("_fl_cell")
    roots = cells.applyInPandas(run, "_fl_tree string, _fl_block long, _fl_blocks long, _fl_hash string")
    return roots.withColumn("_fl_proof", F.array().cast(PROOF))


def exchange(blocks: DataFrame, width: int) -> DataFrame:
    """One round: blocks whose ancestors of ``width`` blocks are siblings meet and hash the parent, each for itself."""
    block, count = F.col("_fl_block"), F.col("_fl_blocks")
    node, low = F.floor(block / width), block % width
    more = count > width
    # A shorter sibling has fewer blocks than there are places: each answers for every size-th place from its own on.
    size = F.least(F.lit(width).cast("long"), count - node * width)
    sent = blocks.select(
        "_fl_tree", F.when(more, F.floor(node / FANOUT)).otherwise(block).alias("_fl_parent"),
        F.explode(F.when(more, F.sequence(low, F.lit(width - 1).cast("long"), size)).otherwise(F.array(low))).alias("_fl_place"),
        (node % FANOUT).cast("int").alias("_fl_digit"), more.alias("_fl_more"),
        low.alias("_fl_low"), block.alias("_fl_block"), "_fl_blocks", "_fl_hash", "_fl_proof",
    )
    home = F.when(F.col("_fl_low") == F.col("_fl_place"), F.struct("_fl_block", "_fl_blocks", "_fl_proof"))
    met = sent.groupBy("_fl_tree", "_fl_parent", "_fl_place", "_fl_more").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_fl_digit").alias("digit"), F.col("_fl_hash").alias("hash"), home.alias("home")))).alias("_fl_run")
    )
    joined = F.array_join(F.transform("_fl_run", lambda x: x.hash), "")
    parent = F.when(F.col("_fl_more"), F.sha2(joined, 256)).otherwise(joined)
    each = met.withColumn("_fl_up", parent).select("_fl_tree", "_fl_more", "_fl_up", "_fl_run", F.explode("_fl_run").alias("_fl_me"))
    others = F.array_join(F.transform(F.filter("_fl_run", lambda x: x.digit != F.col("_fl_me.digit")), lambda x: x.hash), "")
    level = F.array(F.struct(F.col("_fl_me.digit").alias("place"), others.alias("siblings")))
    proof = F.when(F.col("_fl_more"), F.concat("_fl_me.home._fl_proof", level)).otherwise(F.col("_fl_me.home._fl_proof"))
    return each.where("_fl_me.home IS NOT NULL").select(
        "_fl_tree", F.col("_fl_me.home._fl_block").alias("_fl_block"), F.col("_fl_me.home._fl_blocks").alias("_fl_blocks"),
        F.col("_fl_up").alias("_fl_hash"), proof.cast(PROOF).alias("_fl_proof"),
    )


def climbed(leaves: DataFrame, levels: int, largest: int) -> DataFrame:
    """Every block with the root of its tree and its whole upper proof, after as many rounds as the largest tree needs."""
    blocks, width = block_roots(leaves, levels), 1
    while width < -(-largest // FANOUT**levels):
        blocks, width = exchange(blocks, width), width * FANOUT
    return blocks


def folded(leaf: str, proof: list[tuple[int, str]]) -> str:
    """The digest that a leaf and its siblings lead to."""
    for place, siblings in proof:
        leaf = digest(siblings[: 64 * place] + leaf + siblings[64 * place :])
    return leaf


def local_proof(levels: list[list[str]], at: int) -> list[tuple[int, str]]:
    out = []
    for level in levels[:-1]:
        first = at - at % FANOUT
        out.append((at % FANOUT, "".join(level[first:at] + level[at + 1 : first + FANOUT])))
        at //= FANOUT
    return out


def tree_of(nodes: DataFrame, order: list[str], levels: int) -> tuple[DataFrame, DataFrame]:
    """Ranked leaves in cells, and blocks with root and upper proof, also in cells."""
    rows = cut(ranked(nodes, order))
    top = rows.agg(F.max("_fl_size").alias("largest"), F.count(F.lit(1)).alias("rows")).first()
    cells = max(1, -(-top["rows"] // FANOUT**levels))
    leaves = in_cells(rows, F.floor(F.col("_fl_index") / FANOUT**levels), cells)
    return leaves, in_cells(climbed(leaves, levels, top["largest"] or 0), F.col("_fl_block"), cells)


def group_proofs(groups: DataFrame, levels: int) -> DataFrame:
    """(``_fl_tree``, ``_fl_subroot``, ``_fl_root``, ``_fl_above``) of every group, from its name and root."""
    nodes = cut(groups.select(F.lit("").alias("_fl_tree"), F.col("_fl_tree").alias("_fl_name"), "_fl_hash"))
    leaves, blocks = tree_of(nodes, ["_fl_name"], levels)

    def run(_, pdf: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        above = {b: (h, [(p["place"], p["siblings"]) for p in proof]) for b, h, proof in zip(tops["_fl_block"], tops["_fl_hash"], tops["_fl_proof"], strict=True)}
        rows = []
        for (_, block), part in blocks_of(pdf):
            up = levels_of(part["_fl_hash"].tolist(), int(part["_fl_size"].iloc[0]), levels)
            root, rest = above[block]
            for at, (name, own) in enumerate(zip(part["_fl_name"], part["_fl_hash"], strict=True)):
                proof = [{"place": p, "siblings": s} for p, s in local_proof(up, at) + rest]
                rows.append((name, own, root, proof))
        return pd.DataFrame(rows, columns=["_fl_tree", "_fl_subroot", "_fl_root", "_fl_above"])

    both = leaves.groupBy("_fl_cell").cogroup(blocks.groupBy("_fl_cell"))
    return both.applyInPandas(run, f"_fl_tree string, _fl_subroot string, _fl_root string, _fl_above {PROOF}")


def manifest(
    df: DataFrame, key: str = "doc_id", group: str = "source", fields: list[str] | None = None,
    claimed: dict[str, Column] | None = None, levels: int = LEVELS, with_proof: bool = True,
) -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``root``, ``proof`` and its digest, and the root that a claimed row leads to, of every row.

    ``fields`` are what a leaf hashes, in this order. ``claimed`` gives other contents for some of them, as a
    row stands somewhere else; ``folded_root`` is computed from such a row's leaf and the original siblings.
    """
    names = fields or [key, group]
    own = [F.col(f"`{c}`") for c in names]
    other = [(claimed or {}).get(c, F.col(f"`{c}`")) for c in names]
    leaf = leaf_digest(own).alias("_fl_hash")
    source = F.col(f"`{group}`").cast("string")
    # 's' before a group's name keeps the order of bytes and leaves the empty name to the null group.
    nodes = df.select(
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("_fl_tree"), F.col(f"`{key}`").alias("_fl_key"), leaf,
        (leaf_digest(other) if claimed else leaf).alias("_fl_claim"), F.monotonically_increasing_id().alias("_fl_row"),
    )
    leaves, blocks = tree_of(cut(nodes), ["_fl_key", "_fl_hash", "_fl_row"], levels)
    blocks = cut(blocks)
    groups = group_proofs(blocks.where("_fl_block = 0").select("_fl_tree", "_fl_hash"), levels)
    tops = blocks.select("_fl_cell", "_fl_tree", "_fl_block", "_fl_proof").join(groups, "_fl_tree")
    tops = tops.withColumn("_fl_proof", F.concat("_fl_proof", "_fl_above")).drop("_fl_above")

    def run(_, pdf: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        above = {
            (t, b): (sub, root, [(p["place"], p["siblings"]) for p in proof])
            for t, b, sub, root, proof in zip(tops["_fl_tree"], tops["_fl_block"], tops["_fl_subroot"], tops["_fl_root"], tops["_fl_proof"], strict=True)
        }
        rows = []
        for cell, part in blocks_of(pdf):
            sub, root, rest = above[cell]
            up = levels_of(part["_fl_hash"].tolist(), int(part["_fl_size"].iloc[0]), levels)
            tail, whole = "".join(s for _, s in rest), folded(up[-1][0], rest)
            for at, (name, own_leaf, claim) in enumerate(zip(part["_fl_key"], part["_fl_hash"], part["_fl_claim"], strict=True)):
                mine = local_proof(up, at)
                low = folded(claim, mine)
                proof = [{"place": p, "siblings": s} for p, s in mine + rest] if with_proof else None
                rows.append((
                    name, own_leaf, sub, root, proof, digest("".join(s for _, s in mine) + tail),
                    # A block has one root, so what lies above it is folded once, and again only for another root.
                    whole if low == up[-1][0] else folded(low, rest),
                ))
        return pd.DataFrame(rows, columns=["_fl_key", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root"])

    # Keys travel as text, because a null would turn whole numbers into floating ones.
    sent = leaves.withColumn("_fl_key", F.col("_fl_key").cast("string"))
    out = sent.groupBy("_fl_cell").cogroup(tops.groupBy("_fl_cell")).applyInPandas(
        run, f"_fl_key string, leaf string, subroot string, root string, proof {PROOF}, proof_sha256 string, folded_root string"
    )
    return out.select(
        F.col("_fl_key").cast(df.schema[key].dataType).alias(key), "leaf", "subroot", "root",
        *(["proof"] if with_proof else []), "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )

"""Chat formatting as a prefix tree: turns that conversations share at their start are emitted once.

A turn is written as ``### role: text</turn>`` and a line break; inside roles and texts a backslash goes
before each backslash, ``###``, ``</turn>`` and, in roles, ``:``, so that reading back is exact. Tokens are
the UTF-8 bytes of the formatted turn.

A node of the tree is a turn together with all turns before it; its name is a chain of hashes. Equal
nodes of all conversations are one row. Conversations are sorted by their chains; a node's place is that
of the first conversation through it and its depth, which is depth-first order, and the nodes are laid
one behind the other in a token stream. Spark sorts by range, sums inside each range, and adds the sums
of the ranges before, so that one first turn under a third of all conversations is no large group. No
step makes more rows than there are turns. A node has: the interval of its tokens in the stream, the
position id of its first token (the tokens of its ancestors come before), and where its loss mask
begins and ends. A conversation has the intervals of its nodes from the root on: a token sees its own
interval up to itself and those of its ancestors whole.

Null roles and texts are empty. Turns are ordered by number; rows that repeat a number are turns too, by
role and text. Null turn numbers come first, and rows of null conversations are one conversation. Texts
of any length are emitted whole. A conversation is one training example and is put together in one task.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowloom.llm.common import cut

#: Role whose texts are under the loss mask.
LOSS_ROLE = "assistant"
OPEN, CLOSE = "### ", "</turn>\n"
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(role, r"(\\|###|</turn>|:)", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", text) if "\\" in text else text


def formatted(rows: DataFrame) -> DataFrame:
    """Turns with their head, body and tail as token bytes."""
    role = F.coalesce(F.col("_fl_role"), F.lit(""))
    text = F.coalesce(F.col("_fl_text"), F.lit(""))
    return rows.select(
        "_fl_conv", "_fl_turn", (role == LOSS_ROLE).alias("_fl_loss"),
        F.concat(F.lit(OPEN), escaped_role(role), F.lit(": ")).alias("_fl_head"), escaped(text).alias("_fl_body"),
    )


def paths(turns: DataFrame) -> DataFrame:
    """Each conversation with the hashes of its turns and the names of the nodes down to each turn.

    Only hashes are gathered for a conversation, not its texts.
    """
    named = turns.withColumn("_fl_hash", turn_hash())
    convs = named.groupBy("_fl_conv").agg(F.sort_array(F.collect_list(F.struct("_fl_turn", "_fl_hash"))).alias("_fl_items"))
    # The name of a node covers its turn and, through the name before it, all turns above.
    chain = F.aggregate(
        "_fl_items", F.array().cast("array<string>"),
        lambda acc, x: F.concat(acc, F.array(F.substring(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), x["_fl_hash"]), 256), 1, 32))),
    )
    return convs.select("_fl_conv", F.transform("_fl_items", lambda x: x["_fl_hash"]).alias("_fl_hashes"), chain.alias("_fl_chain"))


def turn_hash() -> Column:
    return F.substring(F.sha2(F.concat("_fl_head", "_fl_body"), 256), 1, 32)


def running(df: DataFrame, order: list[str], size: str, out: str) -> DataFrame:
    """``out``: the sum of ``size`` over all rows up to and with each, in the given order.

    Rows are sorted by range and summed inside each range; the sums of the ranges before, one number
    for each partition, are added afterwards.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_fl_range", F.spark_partition_id())
    fields = [*ranged.schema.fields, T.StructField("_fl_sum", T.LongType())]

    def add(batches):
        total = 0
        for pdf in batches:
            if len(pdf):
                sums = total + pdf[size].cumsum()
                total = int(sums.iloc[-1])
                yield pdf.assign(_fl_sum=sums)

    laid = cut(ranged.mapInPandas(add, T.StructType(fields)))
    base, total = [], 0
    for r in laid.groupBy("_fl_range").agg(F.max("_fl_sum").alias("s")).orderBy("_fl_range").collect():
        base += [F.lit(r[0]), F.lit(total)]
        total += r["s"]
    before = F.create_map(*base)[F.col("_fl_range")] if base else F.lit(0)
    return laid.select(*df.columns, (F.col("_fl_sum") + before).alias(out))


def tree(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, conversations).

    Nodes: ``node``, ``parent``, ``depth``, ``start``, ``end`` (interval in the stream), ``position`` (position id
    of the first token), ``loss_start``, ``loss_end`` (offsets in the node, equal where nothing is under the
    mask) and ``tokens`` (bytes). Conversations: ``conv``, and ``intervals``, an array of (depth, node,
    start, end, position) from the root on.
    """
    rows = conversations.select(*[F.col(f"`{c}`").alias(f"_fl_{o}") for c, o in ((conv_id, "conv"), (turn, "turn"), (role, "role"), (text, "text"))])
    turns = formatted(rows)
    # In the order of their chains, conversations that share their first turns stand together, and a node's
    # place depth-first is that of the first conversation that goes through it, and then its depth.
    keyed = paths(turns).select("_fl_hashes", "_fl_chain", "_fl_conv", F.lit(1).cast("long").alias("_fl_one"))
    # The id travels as text through pandas, because a null would turn whole numbers into floating ones.
    ids = keyed.schema["_fl_conv"].dataType
    ranked = running(keyed.withColumn("_fl_conv", F.col("_fl_conv").cast("string")), ["_fl_chain", "_fl_conv"], "_fl_one", "_fl_rank")
    convs = ranked.withColumn("_fl_conv", F.col("_fl_conv").cast(ids))
    step = F.arrays_zip(
        F.col("_fl_chain").alias("node"), F.col("_fl_hashes").alias("hash"), F.concat(F.array(F.lit(None).cast("string")), "_fl_chain").alias("parent"),
    )
    steps = convs.select("_fl_conv", "_fl_rank", F.posexplode(step).alias("depth", "_fl_s")).where("_fl_s.node is not null").select(
        "_fl_conv", "_fl_rank", "depth", F.col("_fl_s.node").alias("node"), F.col("_fl_s.parent").alias("parent"), F.col("_fl_s.hash").alias("_fl_hash"),
    )
    # Equal nodes meet in partial results before the shuffle; depth, parent and turn are the same for all of them.
    shapes = steps.groupBy("node").agg(F.min("_fl_rank").alias("_fl_rank"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("_fl_hash").alias("_fl_hash"))
    size = (F.octet_length("_fl_head") + F.octet_length("_fl_body") + len(CLOSE)).cast("long")
    texts = turns.select(turn_hash().alias("_fl_hash"), "_fl_head", "_fl_body", "_fl_loss").distinct()
    sized = shapes.join(texts.select("_fl_hash", size.alias("_fl_size")), "_fl_hash")
    placed = running(sized, ["_fl_rank", "depth"], "_fl_size", "end").withColumn("start", F.col("end") - F.col("_fl_size"))
    seen = steps.select("_fl_conv", "_fl_rank", "depth", "node").join(placed.select("node", "start", "end"), "node")
    down = W.partitionBy("_fl_rank").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("end") - F.col("start")).over(down), F.lit(0).cast("long"))
    seen = seen.withColumn("position", at)
    examples = seen.groupBy("_fl_rank", F.col("_fl_conv").alias("conv")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "node", "start", "end", "position"))).alias("intervals")
    ).drop("_fl_rank")
    position = seen.groupBy("node").agg(F.min("position").alias("position"))
    nodes = placed.join(position, "node").join(texts, "_fl_hash").select(
        "node", "parent", "depth", "start", "end", "position",
        F.octet_length("_fl_head").cast("long").alias("loss_start"),
        F.when(F.col("_fl_loss"), F.octet_length("_fl_head") + F.octet_length("_fl_body")).otherwise(F.octet_length("_fl_head")).cast("long").alias("loss_end"),
        F.concat("_fl_head", "_fl_body", F.lit(CLOSE)).cast("binary").alias("tokens"),
    )
    return nodes, examples


def read_back(nodes: DataFrame, examples: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the tokens of its intervals.

    A node that a third of all conversations begin with meets them in a join that adaptive execution
    splits. What a turn says is parsed for each node once.
    """
    def parse(batches):
        for pdf in batches:
            rows = []
            for node, tokens, a, b in zip(pdf["node"], pdf["tokens"], pdf["loss_start"], pdf["loss_end"], strict=True):
                whole = bytes(tokens).decode()
                m = TURN.fullmatch(whole)
                if m is None:
                    raise ValueError(f"node {node} is not one turn")
                rows.append((node, unescape(m[1]), unescape(m[2]), unescape(bytes(tokens)[a:b].decode()) if b > a else "", len(whole)))
            yield pd.DataFrame(rows, columns=["node", "role", "text", "loss", "chars"])

    said = nodes.select("node", "tokens", "loss_start", "loss_end").mapInPandas(parse, "node string, role string, text string, loss string, chars long")
    steps = examples.select("conv", F.explode("intervals").alias("i")).select("conv", F.col("i.depth").alias("depth"), F.col("i.node").alias("node"))
    turns = steps.join(said, "node")
    item = F.struct("depth", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "loss", "chars")
    listed = turns.groupBy("conv").agg(F.sort_array(F.collect_list(item)).alias("t"))
    joined = lambda f: F.array_join(F.transform("t", lambda x: x[f]), "")
    return listed.select(
        "conv", F.size("t").cast("long").alias("n_turns"), F.sha2(joined("turn"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"),
    )

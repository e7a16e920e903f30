"""Feature attribution and subband ablation with a plugged-in scorer.

A scorer is a function from a matrix of rows to a matrix of class probabilities; it runs inside the
tasks, and only counts of (true, predicted) are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.wavelet import SUBBANDS, fixed_width_rows
from flowloom.operators.ranking import hash_rank

#: Probabilities of each class for the rows of a matrix.
BatchScorer = Callable[[np.ndarray], np.ndarray]

#: Rows of a block of consecutive places that one task scores at a time.
PERMUTED_ROWS = 4_096
COUNTS = "j int, r int, y_true int, y_pred int, n long"
COUNTS_ARROW = pa.schema([(c, pa.int32()) for c in ("j", "r", "y_true", "y_pred")] + [("n", pa.int64())])


def _counts(j: int, r: int, y: np.ndarray, prob: np.ndarray) -> pd.DataFrame:
    pairs, n = np.unique(np.stack([y, prob.argmax(axis=1)], axis=1), axis=0, return_counts=True)
    return pd.DataFrame({"j": j, "r": r, "y_true": pairs[:, 0], "y_pred": pairs[:, 1], "n": n})


def macro_f1_of_counts(counts: DataFrame, *group: str) -> DataFrame:
    """Macro-F1 over present classes for each group of (y_true, y_pred, n): (*group, macro_f1)."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y_true").alias("c"), F.col("n").alias("t"), zero.alias("p"), hit.alias("tp")),
        F.struct(F.col("y_pred").alias("c"), zero.alias("t"), F.col("n").alias("p"), zero.alias("tp")),
    )
    per = counts.select(*group, F.inline(sides)).groupBy(*group, "c").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp")
    )
    f1 = F.when(F.col("t") > 0, 2.0 * F.col("tp") / (F.col("t") + F.col("p")))
    return per.groupBy(*group).agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"))


def order_hash(seed: int, order: Column, key: str) -> Column:
    """Hash that sorts the rows in order number ``order``; the first order has the plain seed."""
    start = F.when(order == 0, F.lit(f"{seed}|")).otherwise(F.concat(F.lit(f"{seed}/"), order.cast("string"), F.lit("|")))
    return F.md5(F.concat(start, F.col(key).cast("string")))


def with_following(ranked: DataFrame, n: int, block: int, halo: int) -> DataFrame:
    """Rows with place ``_a`` (from 0, of ``n``) dealt to blocks of consecutive places, each followed by ``halo`` more rows.

    Adds ``_block``, ``_at`` (the row's place in its block) and ``_len`` (the block's own rows). The rows
    after the last are the first ones. A row goes to its own block, and to those before it that reach it.
    """
    blocks = max(1, -(-n // block))
    back = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(blocks, -(-halo // block) + 1)).cast("long"))).alias("_back")
    before = F.floor(F.col("_a") / block) - F.col("_back")
    around = before < 0
    dealt = ranked.select("*", back).withColumn("_block", F.when(around, before + blocks).otherwise(before))
    at = F.col("_a") - F.col("_block") * block + F.when(F.floor(F.col("_a") / block) < F.col("_back"), F.lit(n)).otherwise(F.lit(0))
    dealt = dealt.withColumn("_at", at).withColumn("_len", F.least(F.lit(block).cast("long"), F.lit(n) - F.col("_block") * block))
    return dealt.filter(F.col("_at") < F.col("_len") + halo).drop("_back", "_a")


def permutation_importance(
    rows: DataFrame, scorer: BatchScorer, n_features: int, n_repeats: int = 5, seed: int = 42,
    names: Sequence[str] | None = None, key: str = "row_key", features: str = "features",
    orders: int = 1, block: int = PERMUTED_ROWS,
) -> DataFrame:
    """Mean and population deviation of the macro-F1 drop when one raw feature is shuffled.

    All rows are ranked by a hash, and for every (feature, repeat) the values of the feature move along
    that order, around the whole table, by another step each time. ``orders`` is the number of hashes
    that the repeats take in turn; with as many as repeats, each repeat has an order of its own. Ranks are
    cut into blocks, and a block also gets the rows that follow it, as many as the longest step: so the
    result depends neither on ``block`` nor on partitions. Only counts of (true, predicted) leave a block.
    """
    n = rows.count()
    if not 1 <= orders <= n_repeats:
        raise ValueError("orders are one at least and no more than repeats")
    steps = {(j, r): 1 + (j * n_repeats + r) % (n - 1) if n > 1 else 0 for j in range(n_features) for r in range(n_repeats)}
    source = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("_o"), F.col(key).alias("_key"),
        F.col("y_true").cast("int").alias("_y"), F.col(features).cast("array<double>").alias("_x"),
    )
    ranked = hash_rank(source, ["_key"], seed, "_o", out="_a", order_hash=order_hash(seed, F.col("_o"), "_key"))
    dealt = with_following(ranked.withColumn("_a", F.col("_a") - 1).drop("_key"), n, block, max(steps.values(), default=0))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("_at").combine_chunks()
        m, order = part["_len"][0].as_py(), part["_o"][0].as_py()
        x, y = fixed_width_rows(part["_x"].chunk(0), n_features), part["_y"].to_numpy()[:m]
        own = np.array(x[:m])
        out = [_counts(-1, 0, y, scorer(own))] if order == 0 else []
        for j in range(n_features):
            for r in range(order, n_repeats, orders):
                own[:, j] = x[steps[j, r] : steps[j, r] + m, j]
                out.append(_counts(j, r, y, scorer(own)))
            own[:, j] = x[:m, j]
        return pa.Table.from_pandas(pd.concat(out), COUNTS_ARROW, preserve_index=False)

    counts = dealt.groupBy("_o", "_block").applyInArrow(run, COUNTS)
    f1 = macro_f1_of_counts(counts, "j", "r")
    whole = F.max(F.when(F.col("j") == -1, F.col("macro_f1"))).over(Window.partitionBy(F.lit(0)))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1) if names else F.concat(F.lit("f"), F.col("j"))
    drop = F.col("_whole") - F.col("macro_f1")
    table = f1.withColumn("_whole", whole).filter(F.col("j") >= 0).groupBy("j").agg(
        F.avg(drop).alias("mean_decrease"), F.stddev_pop(drop).alias("std_decrease"),
        F.count(F.lit(1)).cast("int").alias("n_repeats"), F.max("_whole").alias("baseline_macro_f1"),
    )
    # equal drops may differ in the last bits; such features rank by position
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("mean_decrease", 9)), "j"))
    return table.select(label.alias("feature"), "mean_decrease", "std_decrease", "n_repeats", "baseline_macro_f1", rank.alias("rank"))


def group_ablation(
    rows: DataFrame, scorer: BatchScorer, subbands: str = "subbands", names: Sequence[str] = SUBBANDS
) -> DataFrame:
    """Macro-F1 with all bands and with each band set to zero; nothing is fitted again.

    Each Arrow batch is scored with every mask and sends only its counts.
    """
    flat = rows.select(F.col("y_true").cast("int").alias("_y"), F.flatten(subbands).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = fixed_width_rows(batch.column(1), len(batch.column(1)[0])), batch.column(0).to_numpy()
            width = x.shape[1] // len(names)
            for mask in range(-1, len(names)):
                part = x
                if mask >= 0:
                    part = x.copy()
                    part[:, mask * width : (mask + 1) * width] = 0.0
                yield pa.RecordBatch.from_pandas(_counts(mask, 0, y, scorer(part)), COUNTS_ARROW, preserve_index=False)

    f1 = macro_f1_of_counts(flat.mapInArrow(run, COUNTS), "j")
    full = F.max(F.when(F.col("j") == -1, F.col("macro_f1"))).over(Window.partitionBy(F.lit(0)))
    drop = F.col("macro_f1_full") - F.col("macro_f1_ablated")
    return (
        f1.select("j", F.col("macro_f1").alias("macro_f1_ablated"), full.alias("macro_f1_full"))
        .filter(F.col("j") >= 0)
        .select(
            F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1).alias("branch"),
            "macro_f1_full", "macro_f1_ablated", drop.alias("macro_f1_drop"),
            F.when(F.col("macro_f1_full") > 0, 100 * drop / F.col("macro_f1_full")).otherwise(F.lit(0.0)).alias("drop_percent"),
        )
    )


def fold_attribution(
    values: DataFrame, attribution: str, n_features: int, names: Sequence[str] | None = None
) -> DataFrame:
    """Mean over rows of |value| summed over bands, per real feature: share in percent and rank.

    ``attribution`` is an array of bands, each an array over positions; padding is dropped.
    """
    bands = values.select(F.posexplode(attribution).alias("_band", "_b"))
    cells = bands.select("_band", F.posexplode("_b").alias("pos", "_v")).filter(F.col("pos") < n_features)
    # every row has each band once, so the mean over rows is the mean over cells times the bands
    mean = cells.groupBy("pos").agg((F.avg(F.abs("_v")) * (F.max("_band") + 1)).alias("mean_abs"))
    return ranked_attribution(mean, names)


def ranked_attribution(mean: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(feature, mean_abs, percent, rank) from (pos, mean_abs), one row per feature."""
    total = F.sum("mean_abs").over(Window.partitionBy(F.lit(0)))
    label: Column = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1) if names else F.concat(F.lit("f"), F.col("pos"))
    return mean.select(
        label.alias("feature"),
        "mean_abs",
        F.when(total > 0, 100 * F.col("mean_abs") / total).otherwise(F.lit(0.0)).alias("percent"),
        F.row_number().over(Window.orderBy(F.desc("mean_abs"), "pos")).alias("rank"),
    )


def linear_attribution(rows: DataFrame, weights: Sequence[Sequence[float]], features: str = "features",
                       names: Sequence[str] | None = None) -> DataFrame:
    """Exact mean |w (x - mean x)| of a linear scorer, summed over its classes.

    Two aggregates with one slot per feature; the weights are a class x feature model.
    """
    width = len(weights[0])
    strength = [sum(abs(w[j]) for w in weights) for j in range(width)]
    means = rows.agg(*[F.avg(F.get(features, j).cast("double")).alias(f"m{j}") for j in range(width)]).first()
    spread = rows.agg(
        *[F.avg(F.abs(F.get(features, j).cast("double") - F.lit(means[j]))).alias(f"s{j}") for j in range(width)]
    )
    structs = [
        F.struct(F.lit(j).alias("pos"), (F.col(f"s{j}") * F.lit(float(strength[j]))).alias("mean_abs"))
        for j in range(width)
    ]
    return ranked_attribution(spread.select(F.inline(F.array(*structs))), names)


def importance_comparison(perm: DataFrame, attr: DataFrame, top: int = 10) -> DataFrame:
    """Both rankings side by side, flagging features in the top of both; no merged score."""
    right = attr.select("feature", F.col("mean_abs"), F.col("rank").alias("rank_attribution"))
    joined = perm.select("feature", "mean_decrease", F.col("rank").alias("rank_permutation")).join(
        right, "feature", "left"
    )
    both = (F.col("rank_permutation") <= top) & F.coalesce(F.col("rank_attribution") <= top, F.lit(False))
    return joined.withColumn("top_consensus", both).orderBy("rank_permutation")


def top_features(table: DataFrame, value: str, k: int = 30) -> DataFrame:
    return table.orderBy(F.desc(value), "feature").limit(k)

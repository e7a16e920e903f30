"""License scan by diagonal voting, in DataFrame functions alone.

Words of a text and of the templates are cut into pairs of neighbours. Every pair of a text is joined
to the template places with the same hash, and the words themselves are compared, so a vote is exact.
A vote lies on the diagonal "word of the text minus word of the template". A base phrase stands where
all its pairs vote on one diagonal. For long templates, diagonals at most ``DRIFT`` apart are merged,
because a word put in or left out shifts those behind it; a merged span is verified by the share of
template places that voted. The pairs never leave the task that made them: votes are summed before the
shuffle, which carries one row for each document and voted diagonal.

Null and empty texts have no words, no labels and score zero. Rows that repeat are reported each. Texts
of any length are scanned whole. Columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom.llm.common import OWN

#: Separators of words, after A-Z are lower-cased; a fixed value.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and labels; fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Longer texts whose labels the method adds.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}
#: Diagonals that may belong to one span, and the share of a template's pairs that a span must hold.
DRIFT, SHARE = 3, 0.75


def pairs_of_templates(base: dict[str, str], templates: dict[str, str]) -> list[tuple]:
    """(template, is base, label, pairs in all, place, first word, second word)."""
    rows = []
    for i, (phrase, label, exact) in enumerate([(p, v, True) for p, v in base.items()] + [(p, v, False) for p, v in templates.items()]):
        words = phrase.split()
        if len(words) < 2:
            raise ValueError("a phrase has two words at least")
        rows += [(i, exact, label, len(words) - 1, at, a, b) for at, (a, b) in enumerate(zip(words, words[1:]))]
    return rows


def words_of(text: Column) -> Column:
    """Words of a text; A-Z are lower-cased, other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), BREAK), lambda w: w != "")


def scan_licenses(
    df: DataFrame, text: str = "text", keep: list[str] | None = None,
    base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES,
) -> DataFrame:
    """``keep``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``."""
    spark = df.sparkSession
    kept = keep or ["doc_id"]
    rows = pairs_of_templates(base, templates)
    if max(size for _, _, _, size, *_ in rows) > 62:
        raise ValueError("the places of a template are bits of a long: give longer texts as several templates")
    lookup = spark.createDataFrame(
        rows, "_fl_t int, _fl_exact boolean, _fl_label string, _fl_size int, _fl_at int, _fl_a string, _fl_b string",
    )
    # One row for each word of the phrases given above: its size is bounded by them.
    places = F.broadcast(lookup.select("_fl_t", "_fl_at", "_fl_a", "_fl_b", F.xxhash64("_fl_a", "_fl_b").alias("_fl_hash")))
    names = F.broadcast(lookup.select("_fl_t", "_fl_exact", "_fl_label", "_fl_size").distinct())
    own = [OWN + f"k{i}" for i in range(len(kept))]
    docs = df.select(
        *[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)],
        F.monotonically_increasing_id().alias("_fl_row"), words_of(F.col(f"`{text}`")).alias("_fl_words"),
    )
    following = F.slice("_fl_words", 2, F.greatest(F.size("_fl_words") - 1, F.lit(0)))
    grams = docs.select(
        *own, "_fl_row", F.size("_fl_words").cast("long").alias("n_words"),
        F.posexplode_outer(F.arrays_zip(F.col("_fl_words").alias("a"), following.alias("b"))).alias("_fl_p", "_fl_g"),
    ).select(*own, "_fl_row", "n_words", "_fl_p", F.col("_fl_g.a").alias("_fl_ga"), F.col("_fl_g.b").alias("_fl_gb"))
    grams = grams.withColumn("_fl_hash", F.xxhash64("_fl_ga", "_fl_gb"))
    same = [grams["_fl_hash"] == places["_fl_hash"], F.col("_fl_ga") == F.col("_fl_a"), F.col("_fl_gb") == F.col("_fl_b")]
    voted = grams.join(places, same, "left").withColumn("_fl_diagonal", F.col("_fl_p") - F.col("_fl_at"))
    # Partial sums come before the shuffle: what has no vote is one row for each document and partition.
    # A word pair that a text repeats votes on another diagonal each time, so places are counted once.
    key = ["_fl_row", *own, "n_words"]
    diagonals = voted.groupBy(*key, "_fl_t", "_fl_diagonal").agg(
        F.expr("bit_or(shiftleft(1L, _fl_at))").alias("_fl_places")
    ).join(names, "_fl_t", "left")
    order = W.partitionBy("_fl_row", "_fl_t").orderBy("_fl_diagonal")
    jump = F.coalesce(F.col("_fl_diagonal") - F.lag("_fl_diagonal").over(order) > DRIFT, F.lit(True))
    spans = diagonals.withColumn("_fl_jump", jump.cast("int")).withColumn("_fl_span", F.sum("_fl_jump").over(order))
    whole = F.col("_fl_exact") & (F.bit_count("_fl_places") == F.col("_fl_size"))
    merged = spans.groupBy(*key, "_fl_t", "_fl_exact", "_fl_label", "_fl_size", "_fl_span").agg(
        F.sum(F.when(whole, 1)).alias("_fl_n"),
        F.min(F.when(whole, F.col("_fl_diagonal"))).alias("_fl_first"),
        F.max(F.when(whole, F.col("_fl_diagonal"))).alias("_fl_last"),
        (F.bit_count(F.bit_or("_fl_places")) / F.col("_fl_size")).alias("_fl_share"),
    )
    found = F.coalesce(F.when(F.col("_fl_exact"), F.col("_fl_n") > 0).otherwise(F.col("_fl_share") >= SHARE), F.lit(False))
    share = F.when(F.col("_fl_t").isNull(), 0.0).when(F.col("_fl_exact"), F.when(found, 1.0).otherwise(0.0)).otherwise(F.col("_fl_share"))
    comma = lambda flag: F.concat_ws(",", F.array_sort(F.collect_set(F.when(flag, F.col("_fl_label")))))
    out = merged.groupBy(*key).agg(
        F.coalesce(F.sum("_fl_n"), F.lit(0)).cast("long").alias("n_base"),
        F.min("_fl_first").cast("long").alias("first_word"), F.max("_fl_last").cast("long").alias("last_word"),
        comma(found & F.col("_fl_exact")).alias("base_labels"), comma(found).alias("labels"),
        F.max(share).alias("score"),
    )
    return out.select(*[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

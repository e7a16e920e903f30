"""Best-fit packing of documents into bins of one capacity, with conflicts.

A document takes as many tokens as it has words between ASCII white space. Pieces of ``CAPACITY`` tokens fill bins of their own;
what is left goes to the bin with the smallest residual that still holds it and has no conflict. Bins
are kept in order of their residual and carry bitmaps: the duplicate clusters in the bin, and one layer
of source bits for each document of a source that a bin may hold. A successor search starts at the first
residual that is large enough and goes on until a bin without a common bit is found, which is then the
tightest compatible one; there is no limit on its steps. Longer pieces are placed first.

Documents are dealt to shards of about ``SHARD`` rows by a hash of the row, so that a source or cluster
with a third of all rows is spread evenly over all shards and no task holds more than a shard. Only ids,
lengths and hashes are moved, never texts. Bins do not cross shards; a bin is (shard, number).

Each row gets one row for each of its pieces. Null and empty texts take no tokens and get one row
without a bin. A null source conflicts with nothing, a text that repeats is in one cluster with its
copies. Rows that repeat an id are placed each. Texts of any length are cut into pieces, none is cut off.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2_048
#: Documents of one source that a bin may hold.
PER_SOURCE = 2
#: Rows of a shard, on average.
SHARD = 2_048


class Bits:
    """A bit for each distinct value, given out as values are met; null has none."""

    def __init__(self) -> None:
        self.known: dict[object, int] = {}

    def of(self, value: object) -> int:
        if value is None or value != value:
            return 0
        return 1 << self.known.setdefault(value, len(self.known))


class Bins:
    """Open bins in order of residual. A bin is (residual, number); bitmaps lie beside."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def new(self) -> int:
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        return len(self.clusters) - 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Number of the tightest compatible bin, and the offset in it."""
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            residual, number = self.open[at]
            if not (self.clusters[number] & cluster or self.sources[number][-1] & source):
                del self.open[at]
                break
            at += 1
        else:
            residual, number = self.capacity, self.new()
        self.clusters[number] |= cluster
        layers = self.sources[number]
        for k in range(self.per_source):
            if not layers[k] & source:
                layers[k] |= source
                break
        if residual > size:
            insort(self.open, (residual - size, number))
        return number, self.capacity - residual


def pack(rows: list[tuple[int, object, object]], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[list[tuple[int, int, int]]]:
    """For each (size, source, cluster) its pieces (bin, offset, size), longest remainders first."""
    bins = Bins(capacity, per_source)
    counts: dict[object, int] = {}
    for _, _, c in rows:
        counts[c] = counts.get(c, 0) + 1
    source_bits, cluster_bits = Bits(), Bits()
    out: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (-(rows[i][0] % capacity), i))
    for i in order:
        size, source, cluster = rows[i]
        for _ in range(size // capacity):
            out[i].append((bins.new(), 0, capacity))
        if size % capacity:
            # A cluster met once in the shard cannot conflict and needs no bit.
            bit = cluster_bits.of(cluster) if counts[cluster] > 1 else 0
            number, offset = bins.place(size % capacity, source_bits.of(source), bit)
            out[i].append((number, offset, size % capacity))
    return out


def pack_documents(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD,
) -> DataFrame:
    """``doc_id``, ``piece``, ``n_tokens``, ``shard``, ``bin`` and ``bin_offset`` of every piece of every row."""
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and documents of a source are one at least")
    shards = max(1, -(-df.count() // shard))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    plain = F.lower(F.trim(F.regexp_replace(body, r"\s+", " ")))
    named = df.select(
        F.col(f"`{doc_id}`").cast("string").alias("_fl_id"), F.col(f"`{source}`").cast("string").alias("_fl_source"), plain.alias("_fl_plain"),
    )
    sized = named.select(
        "_fl_id", "_fl_source",
        F.when(F.col("_fl_plain") == "", 0).otherwise(F.size(F.split("_fl_plain", " "))).cast("long").alias("_fl_size"),
        F.hex(F.xxhash64("_fl_plain")).alias("_fl_hash"), F.sha2("_fl_plain", 224).alias("_fl_cluster"),
    ).withColumn("_fl_shard", F.pmod(F.xxhash64("_fl_id", "_fl_hash"), F.lit(shards)))
    schema = "_fl_id string, piece int, n_tokens long, shard long, bin long, bin_offset long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_fl_id", "_fl_cluster", "_fl_source"], kind="stable", na_position="first")
        rows = list(zip(pdf["_fl_size"].tolist(), pdf["_fl_source"].tolist(), pdf["_fl_cluster"].tolist(), strict=True))
        placed = pack(rows, capacity, per_source)
        lines = []
        for i, pieces in enumerate(placed):
            lines += [(i, k, n, b, o) for k, (b, o, n) in enumerate(pieces)] or [(i, 0, 0, None, None)]
        at, piece, size, number, offset = (list(c) for c in zip(*lines, strict=True))
        return pd.DataFrame({
            "_fl_id": pdf["_fl_id"].to_numpy()[at], "piece": piece, "n_tokens": size, "shard": pdf["_fl_shard"].iloc[0],
            "bin": pd.array(number, "Int64"), "bin_offset": pd.array(offset, "Int64"),
        })

    out = sized.drop("_fl_hash").groupBy("_fl_shard").applyInPandas(run, schema)
    # Ids travel as text, because a null would turn whole numbers into floating ones.
    return out.select(F.col("_fl_id").cast(df.schema[doc_id].dataType).alias(doc_id), "piece", "n_tokens", "shard", "bin", "bin_offset")

"""Approximate nearest neighbours by largest inner product: one small-world graph for each shard.

Distinct vectors are dealt to shards of about ``SHARD`` by a hash. A shard's graph has layers of falling
size. A vector enters its layers after those before it: its links are chosen among its nearest earlier
vectors so that a chosen one is nearer to it than to those already chosen, links go both ways, and a full
list is thinned by the same rule. The nearest earlier vectors come from a blocked product over the shard,
whose size is bounded. Each layer is one flat array of neighbour numbers. Vectors get one component more,
so that all have the same length and the largest inner product is the smallest angle.

Queries go in parts of about ``PART``: a part meets the graph of every shard, goes down the layers and
keeps a beam of ``BEAM`` vectors on the lowest, the queries of a block in step. Queries whose last kept vector the
second half of the beam improves go on with a wider one until it stays. Scores are the inner products of the
original vectors in double precision. The best of all shards are merged for each query.

Copies of a vector have one node. Of their ids only the ``top + 1`` smallest can be among the nearest,
as ties go to smaller ids; a window keeps them before anything is gathered.

Vectors that are null, zero, or hold null or infinite components take no part. Vectors of each length are
searched among themselves; more than ``LENGTHS`` lengths fail. Ids that are null take no part. Rows that repeat an id and a vector count once; an id with several
vectors is a candidate with each, and a query with its smallest. With few candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom.llm.common import cut

SHARD = 16_384
LINKS, CANDIDATES, BEAM, EXPAND, BLOCK = 16, 64, 128, 8, 256
#: Similarities between candidates that are held at once while links are chosen.
PAIRS = 1 << 21
#: Lengths that the vectors of a table may have.
LENGTHS = 1_000
#: Queries that meet a graph in one task.
PART = 2_048
TOP = 20


def chosen(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """For each row at most ``most`` of the candidates, nearest first and spread out; -1 fills up.

    ``sims`` and ``ids`` are candidates by falling similarity, -1 where there is none.
    """
    n, width = ids.shape
    rows = max(1, PAIRS // max(1, width * width))
    if n > rows:
        return np.concatenate([chosen(sims[i : i + rows], ids[i : i + rows], x, most) for i in range(0, n, rows)])
    out = np.full((n, most), -1, np.int32)
    count = np.zeros(n, np.int64)
    nearest = np.full((n, width), -np.inf, np.float32)  # to any candidate chosen so far
    vectors = x[np.maximum(ids, 0)]
    pairs = vectors @ vectors.transpose(0, 2, 1)  # of the candidates of a row, so bounded by their number
    for k in range(width):
        take = np.flatnonzero((ids[:, k] >= 0) & (count < most) & (sims[:, k] > nearest[:, k]))
        if not len(take):
            continue
        out[take, count[take]] = ids[take, k]
        count[take] += 1
        nearest[take] = np.maximum(nearest[take], pairs[take, k])
    # Free places go to the nearest that the rule passed over.
    for k in range(min(width, most)):
        c = ids[:, k]
        free = np.flatnonzero((c >= 0) & (count < most) & ~(out == c[:, None]).any(axis=1))
        out[free, count[free]] = c[free]
        count[free] += 1
    return out


class Graph:
    """Layers of flat neighbour arrays over the unit vectors ``x``; node 0 is the entry."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, layers: list[np.ndarray]):
        self.x, self.levels, self.layers = x, levels, layers

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 7) -> Graph:
        n = len(x)
        rng = np.random.default_rng(seed)
        levels = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64)
        levels = np.minimum(levels, 8)
        levels[0] = levels.max()
        layers = []
        for level in range(int(levels[0]) + 1):
            nodes = np.flatnonzero(levels >= level)
            layers.append(cls.layer(x, nodes, 2 * LINKS if level == 0 else LINKS))
        return cls(x, levels, layers)

    @staticmethod
    def layer(x: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Neighbours of each node of the shard on one layer, -1 where there is none."""
        links = np.full((len(x), most), -1, np.int32)
        for lo in range(0, len(nodes), 512):
            block = nodes[lo : lo + 512]
            sims = x[block] @ x[nodes[: lo + len(block)]].T
            sims[np.arange(len(block))[:, None] + lo <= np.arange(lo + len(block))] = -np.inf
            width = min(CANDIDATES, sims.shape[1])
            part = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            best = np.take_along_axis(sims, part, axis=1)
            order = np.argsort(-best, axis=1, kind="stable")
            best, part = np.take_along_axis(best, order, axis=1), np.take_along_axis(part, order, axis=1)
            ids = np.where(np.isfinite(best), nodes[part], -1)
            links[block, :LINKS] = chosen(best, ids, x, LINKS)
            a, b = np.nonzero(links[block, :LINKS] >= 0)
            Graph.link_back(x, links, links[block, :LINKS][a, b].astype(np.int64), block[a])
        return links

    @staticmethod
    def link_back(x: np.ndarray, links: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        most = links.shape[1]
        table = np.full((len(nodes), most + count.max()), -1, np.int64)
        table[:, :most] = links[nodes]
        table[np.repeat(np.arange(len(nodes)), count), most + np.arange(len(to)) - np.repeat(first, count)] = new
        sims = np.where(table >= 0, np.einsum("nwd,nd->nw", x[np.maximum(table, 0)], x[nodes]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        table, sims = np.take_along_axis(table, order, axis=1), np.take_along_axis(sims, order, axis=1)
        full = (table >= 0).sum(axis=1) > most
        links[nodes[~full]] = table[~full, :most]
        if full.any():
            links[nodes[full]] = chosen(sims[full], table[full], x, most)

    def stable(self, queries: np.ndarray, beam: int, top: int) -> list[np.ndarray]:
        """Ids found for each query, by falling similarity, with beams that widen until the best ``top`` stay.

        A beam is filled to its half first. A query is done if the other half brings no nearer ``top``-th
        vector, else it goes on from what it has found with a beam of twice the width; a beam as wide as the
        graph has seen every vector that can be reached.
        """
        at = np.zeros((len(queries), 1), np.int64)
        for level in range(len(self.layers) - 1, 0, -1):
            at = self.walk(queries, at, self.layers[level], 4)[0]
        out: list[np.ndarray] = [at[0]] * len(queries)
        live = np.arange(len(queries))
        while len(live):
            at, better = self.walk(queries[live], at, self.layers[0], beam, top)
            for row, k in zip(at, live.tolist(), strict=True):
                out[k] = row[row >= 0]
            better &= beam < len(self.x)
            live, at, beam = live[better], at[better], 2 * beam
        return out

    def walk(self, q: np.ndarray, start: np.ndarray, links: np.ndarray, beam: int, top: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the beam by falling similarity, -1 where there is none, and whether its second half brought a nearer ``top``-th."""
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column takes the fill
        seen[:, -1] = True
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        width = min(beam, start.shape[1])
        ids[:, :width] = start[:, :width]
        sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("nwd,nd->nw", self.x[ids[:, :width]], q), -np.inf)
        seen[rows, ids] = True
        open_[:] = ids >= 0
        # Places of the beam that are opened so far, and the top-th similarity when the first half was done.
        reach, place = np.full(n, max(top, beam // 2)), np.arange(beam)
        worst = np.full(n, np.inf, np.float32)
        live = np.arange(n)
        while len(live):
            ready = open_[live] & (place < reach[live, None])
            rest = ~ready.any(axis=1)
            if rest.any():
                half = live[rest & (reach[live] < beam)]
                worst[half], reach[half] = sims[half, min(top, beam) - 1], beam
                live = live[~rest | open_[live].any(axis=1)]
                continue
            # The first open places of each row; a row that has none is done.
            rank = np.cumsum(ready, axis=1)
            r, c = np.nonzero(ready & (rank <= EXPAND))
            nexts = np.full((len(live), EXPAND), -1, np.int64)
            nexts[r, rank[r, c] - 1] = ids[live[r], c]
            open_[live[r], c] = False
            near = np.where(nexts[:, :, None] >= 0, links[nexts], -1).reshape(len(live), -1).astype(np.int64)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            # What is new stands together at the end of each row, so that only few places are looked up in vain.
            near.sort(axis=1)
            near = near[:, near.shape[1] - (near >= 0).sum(axis=1).max(initial=0) :]
            got = np.einsum("nwd,nd->nw", self.x[near], q[live])
            got[near < 0] = -np.inf
            every = np.concatenate([sims[live], got], axis=1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(every, order, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), order, axis=1)
            opened = np.concatenate([open_[live], near >= 0], axis=1)
            open_[live] = np.take_along_axis(opened, order, axis=1) & (ids[live] >= 0)
        return ids, sims[:, min(top, beam) - 1] > worst


def unit(raw: np.ndarray) -> np.ndarray:
    """Vectors with one component more, so that all have length one."""
    x = raw / max(float(np.linalg.norm(raw, axis=1).max()), 1e-300)
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
    return np.column_stack([x, rest]).astype(np.float32)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(``_fl_id``, ``_fl_vec``): finite vectors that are not zero, once each."""
    vec = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(f"`{vec_id}`").alias("_fl_id"), vec.alias("_fl_vec")).where(
        F.col("_fl_id").isNotNull() & F.col("_fl_vec").isNotNull() & finite & F.exists("_fl_vec", lambda v: v != 0)
    )


def graphs(vectors: DataFrame, top: int, lengths: DataFrame) -> DataFrame:
    """One row for each shard: its ids and vectors and its graph as flat arrays."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_fl_id", kind="stable")
        # Copies lie under one node: their ids follow one another in ``ids``, ``node`` says whose they are.
        raw = np.stack(pdf["_fl_vec"].to_numpy())
        _, first, node = np.unique(raw, axis=0, return_index=True, return_inverse=True)
        rng = np.random.default_rng(11)
        order = rng.permutation(len(first))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        raw, node = raw[first[order]], back[node.ravel()]
        g = Graph.build(unit(raw))
        return pd.DataFrame({
            "_fl_shard": [int(pdf["_fl_shard"].iloc[0])], "ids": [pdf["_fl_id"].to_numpy(np.int64).tobytes()], "node": [node.astype(np.int32).tobytes()],
            "raw": [raw.tobytes()], "width": [raw.shape[1]], "levels": [g.levels.tobytes()], "layers": [np.concatenate([x.ravel() for x in g.layers]).tobytes()],
        })

    copies = W.partitionBy("_fl_vec").orderBy("_fl_id")
    few = vectors.distinct().withColumn("_fl_copy", F.row_number().over(copies)).where(F.col("_fl_copy") <= top + 1)
    place = (F.col("_fl_first") + F.pmod(F.xxhash64("_fl_vec"), F.col("_fl_shards"))).cast("int").alias("_fl_shard")
    dealt = few.join(F.broadcast(lengths), F.size("_fl_vec") == F.col("_fl_width")).select("_fl_id", "_fl_vec", place)
    return dealt.groupBy("_fl_shard").applyInPandas(
        build, "_fl_shard int, ids binary, node binary, raw binary, width int, levels binary, layers binary"
    )


def load(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    raw = np.frombuffer(row.raw, np.float64).reshape(-1, row.width)
    levels = np.frombuffer(row.levels, np.int64)
    flat, at, layers = np.frombuffer(row.layers, np.int32), 0, []
    for level in range(int(levels.max()) + 1):
        size = len(levels) * (2 * LINKS if level == 0 else LINKS)
        layers.append(flat[at : at + size].reshape(len(levels), -1))
        at += size
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.node, np.int32), raw, Graph(unit(raw), levels, layers)


def best_of(ids: np.ndarray, node: np.ndarray, raw: np.ndarray, graph: Graph, asks: np.ndarray, names: np.ndarray, top: int, beam: int, kept: int) -> Iterator[tuple]:
    """(query, id, score) of the best candidates of one shard for a block of queries."""
    q = np.column_stack([asks / np.linalg.norm(asks, axis=1, keepdims=True), np.zeros(len(asks))]).astype(np.float32)
    found = graph.stable(q, beam, kept)
    by_node = np.argsort(node, kind="stable")
    starts = np.searchsorted(node[by_node], np.arange(len(raw) + 1))
    for k in range(len(asks)):
        hit = found[k]
        score = raw[hit] @ asks[k]
        order = np.argsort(-score, kind="stable")[: top + 1]
        # Nodes whose score ties with the last one kept stay in the race.
        keep = np.flatnonzero(score >= score[order[-1]])
        members = [by_node[starts[h] : starts[h + 1]] for h in hit[keep]]
        of = np.repeat(score[keep], [len(m) for m in members])
        own = ids[np.concatenate(members)]
        ok = own != names[k]
        own, of = own[ok], of[ok]
        for i in np.lexsort((own, -of))[:top]:
            yield int(names[k]), int(own[i]), float(of[i])


def share_of_shard(top: int, beam: int, shards: int) -> tuple[int, int]:
    """Vectors of the best ``top`` that a shard has to bring with certainty, and the beam for them.

    Vectors are dealt by a hash, so their number in a shard is binomial: mean and two deviations.
    """
    mean = (top + 1) / shards
    kept = min(top + 1, int(np.ceil(mean + 2 * np.sqrt(mean))) + 1)
    return kept, max(2 * kept, -(-beam * kept // (top + 1)))


def nearest(
    df: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
    top: int = TOP, shard: int = SHARD, beam: int = BEAM,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``top`` nearest found of each query, itself left out."""
    vectors = usable(df, vec_id, embedding)
    spark = df.sparkSession
    sizes = vectors.groupBy(F.size("_fl_vec").alias("w")).count().orderBy("w").limit(LENGTHS + 1).collect()
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} lengths")
    # Shards of each length: a query meets those of its own. The table has one row for each length.
    counts = [max(1, -(-r["count"] // shard)) for r in sizes]
    rows = [(r["w"], sum(counts[:i]), n) for i, (r, n) in enumerate(zip(sizes, counts, strict=True))]
    lengths = spark.createDataFrame(rows, "_fl_width int, _fl_first long, _fl_shards long")
    out_schema = "query_id long, vec_id long, score double"
    built = cut(graphs(vectors, top, lengths))
    asked = usable(queries, vec_id, embedding)
    asked = asked.groupBy("_fl_id").agg(F.min("_fl_vec").alias("_fl_vec"))
    parts = max(1, -(-asked.count() // PART))
    # Queries are repeated once for each shard, graphs once for each part of the queries: both sides are bounded.
    asked = asked.join(F.broadcast(lengths), F.size("_fl_vec") == F.col("_fl_width")).select(
        "_fl_id", "_fl_vec", F.pmod(F.xxhash64("_fl_id"), F.lit(parts)).cast("int").alias("_fl_part"),
        F.explode(F.sequence(F.col("_fl_first").cast("int"), (F.col("_fl_first") + F.col("_fl_shards") - 1).cast("int"))).alias("_fl_shard"), "_fl_shards",
    )
    built = built.withColumn("_fl_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(asks: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        lines: list[tuple] = []
        if len(asks) and len(graph):
            ids, node, raw, g = load(next(graph.itertuples(index=False)))
            asks = asks.sort_values("_fl_id")
            kept, width = share_of_shard(top, beam, int(asks["_fl_shards"].iloc[0]))
            for lo in range(0, len(asks), BLOCK):
                block = asks.iloc[lo : lo + BLOCK]
                lines += best_of(ids, node, raw, g, np.stack(block["_fl_vec"].to_numpy()), block["_fl_id"].to_numpy(), top, width, kept)
        return pd.DataFrame(lines, columns=["query_id", "vec_id", "score"])

    key = ["_fl_shard", "_fl_part"]
    met = asked.groupBy(*key).cogroup(built.groupBy(*key))
    found = met.applyInPandas(run, out_schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

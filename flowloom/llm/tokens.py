"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

Texts are split at added special tokens and then into pre-tokens. Distinct pre-tokens of a batch lie
one behind the other in a numpy array of symbols. In every round each pre-token merges all places of
its lowest-ranked pair, all pre-tokens at once; a pre-token leaves when none of its pairs has a rank.
The symbols that survive are its tokens. Merging all places of one pair in a round gives what merging
one place after another gives, because a pair that holds a merged symbol has a higher rank than the
merge that made the symbol. A pre-token of ``LONG`` bytes or more lies alone in linked arrays, with the places
of each rank in a list of their own: a round touches the places of its pair and their neighbours only.

Null and empty texts have zero bytes and tokens. Rows that repeat are counted each. Texts and
pre-tokens of any length are counted whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import long_field, map_texts

#: Split of byte-level vocabularies; a fixed value. White space is the Unicode property.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pre-tokens whose counts a task remembers before it starts anew.
REMEMBERED = 600_000
NONE = np.int32(2**31 - 1)
#: Bytes from which a pre-token is merged by itself.
LONG = 2_000


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: printable Latin-1 stands for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Merge ranks of a vocabulary as arrays; ``counts`` gives the number of tokens of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in byte_alphabet().items():
            self.byte_ids[byte] = vocab[char]
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        lens = np.array([len(w) for w in words], np.int64)
        result = lens.copy()
        if len(long := np.flatnonzero(lens >= LONG)):
            for i in long:
                result[i] = self.count_long(self.byte_ids[np.frombuffer(words[i], np.uint8)])
            rest = np.flatnonzero(lens < LONG)
            result[rest] = self.counts([words[i] for i in rest])
            return result
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), lens)
        while len(sym):
            rank = np.full(len(sym), NONE, np.int32)
            inner = np.flatnonzero(seq[1:] == seq[:-1])
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            result[seq[starts]] = sizes
            lowest = np.repeat(best, sizes)
            alive = lowest != NONE
            hits = np.flatnonzero((rank == lowest) & alive)
            if not len(hits):
                break
            new_run = np.r_[True, np.diff(hits) != 1]
            place = np.arange(len(hits)) - np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
            hits = hits[place % 2 == 0]  # of overlapping equal pairs, each second one from the left
            sym[hits] = self.merged[rank[hits]]
            alive[hits + 1] = False
            sym, seq = sym[alive], seq[alive]
        return result


    def count_long(self, sym: np.ndarray) -> int:
        """Tokens of one pre-token given by its bytes' symbols."""
        n = left = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.rank(sym[:-1], sym[1:]), NONE)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                if len(part):
                    r = int(rank[part[0]])
                    if r not in places:
                        places[r] = []
                        heapq.heappush(heap, r)
                    places[r].append(part)

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.concatenate(places.pop(r))
            at = np.unique(at[rank[at] == r])  # others have merged with a neighbour since
            if not len(at):
                continue
            new_run = np.r_[True, after[at[:-1]] != at[1:]]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            gone = after[at]
            sym[at] = self.merged[r]
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            rank[gone] = NONE
            left -= len(at)
            touched = np.unique(np.concatenate([at, before[at]]))
            touched = touched[touched >= 0]
            rank[touched] = NONE
            inner = touched[after[touched] < n]
            rank[inner] = self.rank(sym[inner], sym[after[inner]])
            add(touched)
        return left


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def counter(path: str) -> Callable[[list[str]], list[list]]:
    """Counts whole texts. What stands between two single spaces is split and counted once and then remembered."""
    m = merger(path)
    split = regex.compile(SPLIT).findall
    apart = regex.compile("|".join(map(regex.escape, sorted(m.special, key=len, reverse=True)))) if m.special else None
    pieces: dict[str, int] = {}
    spaced: dict[str, int] = {}

    def learn(words: set[str]) -> None:
        fresh = [w for w in words if w not in pieces]
        if fresh:
            pieces.update(zip(fresh, m.counts([w.encode() for w in fresh]).tolist(), strict=True))

    def count(texts: list[str]) -> list[list]:
        for memory in (pieces, spaced):
            if len(memory) > REMEMBERED:
                memory.clear()
        n_special = [len(apart.findall(t)) if apart and any(x in t for x in m.special) else 0 for t in texts]
        runs = [[] if n else t.split(" ") for t, n in zip(texts, n_special, strict=True)]
        firsts = [r.pop(0) if r else "" for r in runs]
        unseen = {w for w in set().union(*runs) if w not in spaced}
        # A space next to other white space or an end: its neighbours decide how it is split.
        uneven = {w for w in unseen if not w or w[0].isspace() or w[-1].isspace()}
        whole = []
        for i, (t, n, first) in enumerate(zip(texts, n_special, firsts, strict=True)):
            if n or first[-1:].isspace() or not first or (uneven and not uneven.isdisjoint(runs[i])):
                whole.append([w for piece in (apart.split(t) if n else [t]) for w in split(piece)])
                runs[i] = []
            else:
                whole.append(split(first))
        unseen = {w: split(" " + w) for w in unseen - uneven}
        learn(set().union(*whole, *unseen.values()))
        known = pieces.__getitem__
        spaced.update((w, sum(map(known, p))) for w, p in unseen.items())
        after_space = spaced.__getitem__
        return [
            [len(t.encode()) for t in texts],
            [n + sum(map(known, w)) + sum(map(after_space, r)) for n, w, r in zip(n_special, whole, runs, strict=True)],
        ]

    return count


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, limit: int = 512) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row; ``vocabulary`` is a file on every executor."""
    fields = [long_field("n_bytes"), long_field("n_tokens")]
    out = map_texts(df, text, keep or ["doc_id"], fields, lambda: counter(vocabulary))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

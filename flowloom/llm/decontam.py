"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The items are the indexed side; a document's overlapping passages are the queries. A posting's weight is
the item's BM25 term weight divided by the least score that a passage can have which the check below accepts,
so 1 is the threshold of every item and no acceptable passage stays under it. Items are sorted by length and
lie in blocks; the index keeps the largest weight of each term in each block. A passage adds up these block
maxima: where the sum stays below the threshold no item of the block can reach it, and the block is skipped.
Within the blocks that remain, WAND walks the postings: it advances to the first item whose terms' maxima
together reach the threshold, and scores only such items. All items above the threshold are retrieved, none
is cut off by rank.

A retrieved item is verified on the passage. Where its text marks an answer ("Answer:"), and question and
answer have five words or more each, ``OVERLAP`` of the word five-shingles of the one and of the other must be
there, and the share is the lesser of both. Otherwise the item is one part. Items without a mark are not
parted by guess: a short last sentence that is changed or missing leaves a near copy of the item.

A passage of an item with n words is two neighbouring cells of 2^b words, 64 at least, 2^b the least power of
two above n; passages overlap by one cell. A shingle counts in a passage that holds all of it.

Items are taken in passes of at most ``GROUP_ITEMS`` items and ``GROUP_CHARS`` characters, and lie in indexes of
at most ``INDEX_ITEMS``; passages meet an index in slices of ``SLICE`` sums. So what a task holds beside its
words is bounded whatever the size of benchmark and documents. Term statistics are those of all items.

Null and empty items match nothing, null and empty documents contain nothing. Ids of items have any type that can be
ordered; items without an id match like others and leave a null id. An item shorter than five words is one
shingle. Rows that repeat give each a row; items that repeat match each. Documents of any length are read
whole. Extra columns, of whatever name, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import map_texts

K1, B = 1.2, 0.75
#: Score from which an item is retrieved, in units of the least score of a passage that is accepted.
THRESHOLD = 1.0
SHINGLE, OVERLAP = 5, 0.8
BLOCK_ITEMS = 4
GROUP_ITEMS, GROUP_CHARS = 65_536, 8_000_000
INDEX_ITEMS = 4_096
#: Sums of cells by blocks that are held at once.
SLICE = 4_000_000
#: Terms in more blocks than this are added up by a matrix product, the others one by one.
COMMON = 6

#: Letters, marks, digits and underscores; without marks the plain pattern finds the same, and faster.
WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
PLAIN_WORD = re.compile(r"\w+")
BEYOND_LATIN = re.compile("[\u0300-\U0010ffff]")
#: What parts words in ASCII texts, where a table does what the pattern does.
BREAKS = {c: " " for c in range(128) if not PLAIN_WORD.match(chr(c))}
ANSWER = re.compile(r"\banswer\s*:", re.ASCII)


def words(text: str) -> list[str]:
    """Lower-cased runs of letters, marks, digits and underscores."""
    low = text.lower()
    if low.isascii():
        return low.translate(BREAKS).split()
    return (WORD if BEYOND_LATIN.search(low) else PLAIN_WORD).findall(low)


def parts_of(text: str) -> list[list[str]]:
    """Words of question and answer, where an answer is marked and both are long enough; else all in one part."""
    split = ANSWER.split(text.lower(), maxsplit=1)
    parts = [words(x) for x in split]
    return parts if len(parts) == 2 and min(map(len, parts)) >= SHINGLE else [words(text)]


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def cell_class(n: int) -> int:
    """b of the cells of 2^b words in which an item of n words is looked for."""
    return max(6, n.bit_length())


@dataclass
class Item:
    number: int
    item_id: object
    parts: list[list[str]]

    def __post_init__(self) -> None:
        self.words = [w for p in self.parts for w in p]
        self.shingles = [shingles(p) for p in self.parts]

    def confirmed(self, passage: list[str]) -> float:
        """Least share of the shingles of a part that the passage holds; 0 if it is too small."""
        if len(self.words) < SHINGLE:
            n = len(self.words)
            share = float(any(passage[i : i + n] == self.words for i in range(len(passage) - n + 1)))
        else:
            here = shingles(passage)
            share = min(len(s & here) / len(s) for s in self.shingles)
        return share if share >= OVERLAP else 0.0

    def least_score(self, weights: dict[str, float]) -> float:
        """A bound that no accepted passage stays below, as the sum of the weights of the item's words there.

        A word is missing only if all its shingles are. Spread evenly over them, its weight is lost with the
        missing shingles, and an accepted passage misses so many of each part at most.
        """
        if len(self.words) < SHINGLE:
            return sum(weights.values())
        spread = Counter(w for p in self.shingles for s in p for w in set(s))
        lost = least = 0.0
        for part in self.shingles:
            missing = sum(k / len(part) >= OVERLAP for k in range(len(part)))  # as many as may be missing
            costs = sorted((sum(weights[w] / spread[w] for w in set(s)) for s in part), reverse=True)
            lost += sum(costs[:missing])
            least = max(least, min(sum(weights[w] for w in set(s)) for s in part))  # one shingle is there
        return max(sum(weights.values()) - lost, least)


class BlockMaxIndex:
    """Postings of items of one class of lengths; passages are two cells of ``cell`` words."""

    def __init__(self, items: list[Item], idf: dict[str, float], mean: float):
        self.items = sorted(items, key=lambda x: (len(x.words), x.number))
        self.cell = 1 << max((cell_class(len(x.words)) for x in items), default=6)
        self.terms: dict[str, int] = {}
        lists: list[list[tuple[int, float]]] = []
        for at, item in enumerate(self.items):
            n = len(item.words)
            raw = {x: idf[x] * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for x, f in Counter(item.words).items()}
            least = item.least_score(raw)
            for w, x in raw.items():
                k = self.terms.setdefault(w, len(self.terms))
                if k == len(lists):
                    lists.append([])
                lists[k].append((at, x / least))
        self.blocks = -(-len(self.items) // BLOCK_ITEMS)
        self.lists = lists
        self.block_peaks = [self.peaks(p) for p in lists]
        wide = np.array([len(p) > COMMON for p in self.block_peaks])
        self.wide = np.where(wide, np.cumsum(wide) - 1, -1)
        self.wide_peaks = np.zeros((int(wide.sum()), self.blocks), np.float32)
        for k in np.flatnonzero(wide):
            for b, x in self.block_peaks[k].items():
                self.wide_peaks[self.wide[k], b] = x
        narrow = [{} if w else p for w, p in zip(wide, self.block_peaks, strict=True)]
        self.starts = np.r_[0, np.cumsum([len(p) for p in narrow])]
        self.to_block = np.array([b for p in narrow for b in p], np.int64)
        self.to_peak = np.array([x for p in narrow for x in p.values()])

    @staticmethod
    def peaks(postings: list[tuple[int, float]]) -> dict[int, float]:
        out: dict[int, float] = {}
        for at, x in postings:
            out[at // BLOCK_ITEMS] = max(out.get(at // BLOCK_ITEMS, 0.0), x)
        return out

    def hopeful(self, term: np.ndarray, cell: np.ndarray, cells: int, follows: np.ndarray) -> list[tuple[int, int]]:
        """(first cell of a passage, block) whose block maxima reach the threshold.

        ``term`` and ``cell`` are the indexed words of many documents and the cells they stand in;
        ``follows`` says for each cell whether the next one belongs to the same document.
        """
        # A passage is its cell and the next one; a term that stands there twice counts once.
        before = np.flatnonzero((cell > 0) & np.r_[False, follows[:-1]][cell])
        width = len(self.lists)
        keys = np.sort(np.concatenate([cell * width + term, (cell[before] - 1) * width + term[before]]))
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        cell, term = keys // width, keys % width
        out: list[tuple[int, int]] = []
        rows = max(1, SLICE // max(1, self.blocks + len(self.wide_peaks)))
        for lo in range(0, cells, rows):
            a, b = np.searchsorted(cell, [lo, lo + rows])
            if a < b:
                sums = self.bounds(term[a:b], cell[a:b] - lo, min(rows, cells - lo))
                out += [(lo + int(c), int(k)) for c, k in np.argwhere(sums >= THRESHOLD - 1e-5)]
        return out

    def bounds(self, term: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
        """Sums of the block maxima of the words of each cell, for each block."""
        wide = self.wide[term]
        here = np.flatnonzero(wide >= 0)
        there = np.zeros((cells, len(self.wide_peaks)), np.float32)
        there[cell[here], wide[here]] = 1
        table = there @ self.wide_peaks
        rest = np.flatnonzero(wide < 0)
        cell, term = cell[rest], term[rest]
        n = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        key = np.repeat(cell, n) * self.blocks + self.to_block[at]
        return table + np.bincount(key, self.to_peak[at], cells * self.blocks).reshape(cells, self.blocks)

    def wand(self, query: set[int], block: int) -> list[int]:
        """Items of a block whose score reaches the threshold, by WAND over the postings of the query's terms."""
        lo, hi = block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS
        cursors = []
        for k in query:
            if block in self.block_peaks[k]:
                here = [p for p in self.lists[k] if lo <= p[0] < hi]
                cursors.append([here, 0, self.block_peaks[k][block]])
        out = []
        while True:
            cursors = [c for c in cursors if c[1] < len(c[0])]
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[2]
                if bound >= THRESHOLD - 1e-9:
                    pivot = c[0][c[1]][0]
                    break
            if pivot is None:
                return out
            if cursors[0][0][cursors[0][1]][0] == pivot:
                total = sum(c[0][c[1]][1] for c in cursors if c[0][c[1]][0] == pivot)
                if total >= THRESHOLD - 1e-9:
                    out.append(pivot)
                target = pivot + 1
            else:
                target = pivot
            for c in cursors:
                while c[1] < len(c[0]) and c[0][c[1]][0] < target:
                    c[1] += 1


def searcher(indexes: list[BlockMaxIndex]) -> Callable[[list[str]], list[list[tuple[object, float]]]]:
    """For each text the items it contains, each with the largest confirmed share, in the order of their numbers."""
    def search(texts: list[str]) -> list[list[tuple[object, float]]]:
        found: list[dict[int, tuple[object, float]]] = [{} for _ in texts]
        docs = [words(t) for t in texts]
        sizes = np.array([len(d) for d in docs], np.int64)
        for ix in indexes:
            if not ix.items:
                continue
            get = ix.terms.get
            term = np.fromiter(map(get, chain.from_iterable(docs), repeat(-1)), np.int64, sizes.sum())
            doc = np.repeat(np.arange(len(docs)), sizes)
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(term)) - first[doc]
            n_cells = -(-sizes // ix.cell)
            base = np.cumsum(n_cells) - n_cells
            cell = base[doc] + place // ix.cell
            of = np.repeat(np.arange(len(docs)), n_cells)
            follows = np.r_[of[1:] == of[:-1], False] if len(of) else np.zeros(0, bool)
            known = np.flatnonzero(term >= 0)
            if not len(known):
                continue
            for c, block in ix.hopeful(term[known], cell[known], len(of), follows):
                d = of[c]
                at = (c - base[d]) * ix.cell
                passage = docs[d][at : at + 2 * ix.cell]
                query = {k for w in passage if (k := get(w)) is not None}
                for i in ix.wand(query, block):
                    item = ix.items[i]
                    share = item.confirmed(passage)
                    if share > found[d].get(item.number, (None, 0.0))[1]:
                        found[d][item.number] = (item.item_id, share)
        return [[f[n] for n in sorted(f)] for f in found]

    return search


def item_groups(items: DataFrame, text: str, item_id: str) -> list[list[tuple[object, str]]]:
    """Items in bounded groups, read one at a time; each group is one pass over the documents."""
    groups: list[list[tuple[object, str]]] = [[]]
    size = 0
    named = items.select(F.col(f"`{item_id}`").alias("_fl_id"), F.col(f"`{text}`").cast("string").alias("_fl_text"))
    for i, t in named.where("_fl_text is not null").orderBy("_fl_id", "_fl_text").toLocalIterator():
        if groups[-1] and (len(groups[-1]) >= GROUP_ITEMS or size + len(t) > GROUP_CHARS):
            groups.append([])
            size = 0
        groups[-1].append((i, t))
        size += len(t)
    return groups


def build(group: list[tuple[object, str]], idf: dict[str, float], mean: float) -> list[BlockMaxIndex]:
    """Indexes of each class of lengths, so that a cell is at most twice as long as an item of 64 words or more."""
    classes: dict[int, list[Item]] = {}
    for number, (i, t) in enumerate(group):
        item = Item(number, i, parts_of(t))
        if item.words:
            classes.setdefault(cell_class(len(item.words)), []).append(item)
    return [BlockMaxIndex(x[k : k + INDEX_ITEMS], idf, mean) for _, x in sorted(classes.items()) for k in range(0, len(x), INDEX_ITEMS)]


def statistics(groups: list[list[tuple[object, str]]]) -> tuple[dict[str, float], float]:
    df: Counter[str] = Counter()
    n = total = 0
    for g in groups:
        for _, t in g:
            w = words(t)
            df.update(set(w))
            n += 1
            total += len(w)
    return {w: float(np.log(1 + (n - c + 0.5) / (c + 0.5))) for w, c in df.items()}, max(1.0, total / max(1, n))


def leak_type(item_id: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", item_id), T.StructField("share", T.DoubleType())]))


def leaks_of(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", name: str = "leaks", item_text: str = "text") -> DataFrame:
    """``keep`` and ``leaks``, an array of (item_id, share) by item: empty for clean documents."""
    kept = keep or ["doc_id"]
    groups = item_groups(items, item_text, item_id)
    idf, mean = statistics(groups)
    kind = leak_type(items.schema[item_id].dataType)
    out = docs
    names = []
    for g, group in enumerate(groups):
        names.append(f"_fl_leaks{g}")
        own = {w: idf[w] for _, t in group for w in set(words(t))}

        def make(group: list = group, own: dict = own) -> Callable[[list[str]], list[list]]:
            search = searcher(build(group, own, mean))
            return lambda texts: [[[{"item_id": i, "share": s} for i, s in found] for found in search(texts)]]

        columns = [*dict.fromkeys([*kept, text]), *names[:-1]]
        out = map_texts(out, text, columns, [T.StructField(names[-1], kind)], make)
    every = reduce(lambda a, b: F.concat(a, b), map(F.col, names))
    return out.select(*[f"`{c}`" for c in kept], F.array_sort(every).alias(name))

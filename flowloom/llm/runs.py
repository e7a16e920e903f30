"""Periodic runs of words by recompression: a run-length grammar answers how far equal stretches extend.

A run is a stretch of words with smallest period q, at least ``REPEATS`` periods and ``MIN_WORDS`` words
long, that no neighbouring word extends. All texts of a batch share one grammar. Its levels alternate
between block compression, where a maximal block of one symbol becomes one symbol named by (symbol,
length), and pair compression, where symbols are parted into left and right ones and each neighbouring
pair (left, right) becomes one symbol. Names depend on content alone, so equal stretches have equal
symbols but for a few at their ends. Each text stands between two symbols that occur nowhere else.

Candidates come from the harmonic grid: for each period p the places that are multiples of 2p. A run of
4p words covers a grid place i with words i to i+p equal to those p further on; places where the ends
of that stretch differ are left out. For the others the grammar tells the exact common extension of
i and i+p to both sides: a query climbs while both places begin a symbol of the next level, skips
equal symbols (whole blocks at once), and goes down again at the first difference. Only texts with a
candidate enter the grammar. Work is n log n queries for n words at most, each logarithmic.

Null and empty texts have no words and no runs. Rows that repeat are reported each. Texts of any length
are read whole, one text after the other if they are long. Columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowloom.llm.common import long_field, map_texts, string_field

REPEATS, MIN_WORDS = 4, 6
RUNS = "runs"
#: Grid places that are held at once.
GRID_ROWS = 1 << 21


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, as bytes."""
    return text.encode().split()


class Level:
    """Symbols of one level and how they hang together with the level below and above.

    ``ahead`` and ``behind`` say how many symbols of the same kind follow, and came before, with the
    symbol itself; ``first`` and ``last`` are the outer children below, ``up`` is the parent above.
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None):
        self.symbols, self.first, self.last = symbols, first, last
        n = len(symbols)
        new = np.r_[True, symbols[1:] != symbols[:-1]]
        self.starts = np.flatnonzero(new)
        self.lengths = np.diff(np.r_[self.starts, n])
        block = np.cumsum(new) - 1
        self.behind = (np.arange(n) - self.starts[block] + 1).astype(np.int32)
        self.ahead = (self.lengths[block] - self.behind + 1).astype(np.int32)
        self.up: np.ndarray | None = None


def named(keys: np.ndarray) -> np.ndarray:
    """A small number for each distinct key."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int32)


class Grammar:
    """Levels over a sequence of symbols, and the words that each symbol spells."""

    def __init__(self, symbols: np.ndarray, texts: int, seed: int = 1):
        """``texts`` is the number of texts in the sequence; the levels end when each is one symbol, or none shrinks."""
        level, width = Level(symbols.astype(np.int32)), np.ones(len(symbols), np.int64)
        self.levels, self.widths = [level], [width]
        rng, still = np.random.default_rng(seed), 0
        while len(level.symbols) > texts and still < 8:
            for compress in (self.blocks, self.pairs):
                groups, name = compress(level, rng)
                if len(groups) == len(level.symbols):
                    still += compress == self.pairs
                    continue
                still = 0
                ends = np.r_[groups[1:], len(level.symbols)] - 1
                level.up = np.repeat(np.arange(len(groups), dtype=np.int32), ends - groups + 1)
                width = np.add.reduceat(width, groups)
                level = Level(name, groups.astype(np.int32), ends.astype(np.int32))
                self.levels.append(level)
                self.widths.append(width)

    @staticmethod
    def blocks(level: Level, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Start and name of every maximal block of one symbol."""
        return level.starts, named(level.symbols[level.starts].astype(np.int64) << 32 | level.lengths)

    @staticmethod
    def pairs(level: Level, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Start and name of every pair (left, right) and of every symbol outside of one."""
        s = level.symbols
        side = rng.random(int(s.max()) + 1) < 0.5
        left = side[s]
        joint = left[:-1] & ~left[1:]
        start = np.r_[True, ~joint]
        groups = np.flatnonzero(start)
        two = np.r_[joint, False][groups]
        second = np.where(two, s[np.minimum(groups + 1, len(s) - 1)].astype(np.int64) + 1, 0)
        return groups, named(s[groups].astype(np.int64) << 32 | second)

    def extension(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """Number of equal words from places ``a`` and ``b`` on (or back from them, both included).

        A place is a word of the lowest level; the sequences must differ somewhere, as they do where texts
        end in symbols of their own.
        """
        step = 1 if forward else -1
        total = np.zeros(len(a), np.int64)
        x, y = a.astype(np.int64), b.astype(np.int64)
        split = np.full(len(a), -1)  # the level at which a query met its first difference
        live = np.arange(len(a))
        for depth, level in enumerate(self.levels):
            top = depth + 1 == len(self.levels)
            if not len(live):
                break
            live, wait = live[:0], live
            while len(wait):
                if not top:
                    ready = self.at_edge(level, x[wait], forward) & self.at_edge(level, y[wait], forward)
                    live = np.concatenate([live, wait[ready]])
                    wait = wait[~ready]
                wait = self.skip(level, self.widths[depth], x, y, total, wait, step, split, depth)
            if not top:
                x[live], y[live] = level.up[x[live]], level.up[y[live]]
        for depth in range(len(self.levels) - 1, 0, -1):
            at, below = np.flatnonzero(split == depth), self.levels[depth - 1]
            child = self.levels[depth].first if forward else self.levels[depth].last
            x[at], y[at] = child[x[at]], child[y[at]]
            while len(at):
                at = self.skip(below, self.widths[depth - 1], x, y, total, at, step, split, depth - 1)
        return total

    @staticmethod
    def at_edge(level: Level, x: np.ndarray, forward: bool) -> np.ndarray:
        """Whether a symbol is the first (or last) child of its parent."""
        up = level.up
        if forward:
            return (x == 0) | (up[x] != up[np.maximum(x - 1, 0)])
        return (x == len(up) - 1) | (up[x] != up[np.minimum(x + 1, len(up) - 1)])

    @staticmethod
    def skip(level: Level, width: np.ndarray, x: np.ndarray, y: np.ndarray, total: np.ndarray, at: np.ndarray, step: int, split: np.ndarray, depth: int) -> np.ndarray:
        """Move queries past equal symbols, and mark those that differ; gives back the ones that moved."""
        same = level.symbols[x[at]] == level.symbols[y[at]]
        split[at[~same]] = depth
        at = at[same]
        rest = level.ahead if step > 0 else level.behind
        n = np.minimum(rest[x[at]], rest[y[at]])
        total[at] += n * width[x[at]]
        x[at] += step * n
        y[at] += step * n
        return at


def grid(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, period) of the harmonic grid of texts with ``sizes`` words.

    The first grid place i in a run of 4p words has words i to i+2p in the run.
    """
    most = np.maximum(sizes // REPEATS, 0)
    most[sizes < MIN_WORDS] = 0
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    steps = -(-(sizes[text] - 2 * period) // (2 * period))
    steps = np.maximum(steps, 0)
    k = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    period = np.repeat(period, steps)
    return np.repeat(text, steps), 2 * period * k, period


def candidates(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid places whose stretch of p words may repeat p further on, as (text, place, period)."""
    # About n/2 ln n places a text; long texts come in pieces of their own.
    weight = np.cumsum(sizes * np.log2(np.maximum(sizes, 2)) / 2)
    piece = (weight // GRID_ROWS).astype(np.int64)
    found = []
    for p in np.unique(piece):
        at = np.flatnonzero(piece == p)
        text, place, period = grid(sizes[at])
        i = starts[at][text] + place
        equal = (codes[i] == codes[i + period]) & (codes[i + 1] == codes[i + 1 + period])
        text, place, period, i = text[equal], place[equal], period[equal], i[equal]
        equal = codes[i + period] == codes[i + 2 * period]
        found.append((at[text[equal]], place[equal], period[equal]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs, rows (start, length, period) by start and period."""
    none = np.zeros((0, 3), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(texts) or sizes.max() < MIN_WORDS:
        return [none] * len(texts)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int32, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    text, place, period = candidates(codes, starts, sizes)
    out: list[np.ndarray] = [none] * len(texts)
    if not len(text):
        return out
    chosen, text = np.unique(text, return_inverse=True)
    # Each text between two symbols of its own, so that no extension leaves it.
    ends = len(known) + 2 * np.arange(len(chosen))
    sequence = np.concatenate([np.r_[e, codes[starts[c] : starts[c] + sizes[c]], e + 1] for c, e in zip(chosen, ends, strict=True)])
    first = np.cumsum(sizes[chosen] + 2) - sizes[chosen] - 1
    grammar = Grammar(sequence, len(chosen))
    lo, hi = spans(grammar, first[text] + place, period)
    length = hi - lo
    enough = length >= np.maximum(MIN_WORDS, REPEATS * period)
    rows = np.stack([text[enough], (lo - first[text])[enough], length[enough], period[enough]], axis=1)
    # A stretch that is found with a multiple of its period is the same stretch; the smallest period stays.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    at = np.searchsorted(rows[:, 0], np.arange(len(chosen) + 1))
    for k, c in enumerate(chosen):
        out[c] = rows[at[k] : at[k + 1], 1:]
    return out


def spans(grammar: Grammar, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the longest stretch with the period around each place.

    Grid places of one period that lie in the same stretch have the same answer, so that three times the
    first open place of every chain of neighbours is asked and the places it covers take its answer;
    then all that are still open are asked.
    """
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    lo, hi = np.full(len(place), -1), np.full(len(place), -1)
    linked = np.r_[False, (period[1:] == period[:-1]) & (place[1:] == place[:-1] + 2 * period[1:])]
    chain = np.cumsum(~linked) - 1
    open_ = np.arange(len(place))
    for turn in range(4):
        if not len(open_):
            break
        heads = open_ if turn == 3 else open_[np.r_[True, chain[open_[1:]] != chain[open_[:-1]]]]
        i, p = place[heads], period[heads]
        lo[heads] = i - grammar.extension(i - 1, i - 1 + p, False)
        hi[heads] = i + p + grammar.extension(i, i + p, True)
        if turn < 3:
            head = np.searchsorted(chain[heads], chain[open_])
            covered = (place[open_] >= place[heads][head]) & (place[open_] + period[open_] <= hi[heads][head])
            lo[open_[covered]], hi[open_[covered]] = lo[heads][head[covered]], hi[heads][head[covered]]
            open_ = open_[~covered]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return lo[back], hi[back]


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words without what a run repeats: of each run its first period stays."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(edge)[:-1] == 0
    return b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s).decode()


def find_runs(
    df: DataFrame, text: str = "text", keep: list[str] | None = None,
    words: Callable[..., list[bytes]] = words_of, others: list[str] | None = None,
) -> DataFrame:
    """``keep``, ``n_words``, ``runs`` (start, length, period, by start and period) and ``collapsed`` of every row.

    ``words`` takes a text, and the columns ``others`` of its row, and gives the words.
    """
    each = T.StructType([long_field("start"), long_field("length"), long_field("period")])
    fields = [long_field("n_words"), T.StructField(RUNS, T.ArrayType(each)), string_field("collapsed")]

    def make() -> Callable[..., list[list]]:
        def run(texts: list[str], *more: list) -> list[list]:
            split = [words(*row) for row in zip(texts, *more, strict=True)]
            found = runs_of(split)
            return [
                [len(w) for w in split],
                [[{"start": s, "length": n, "period": p} for s, n, p in r.tolist()] for r in found],
                [collapsed(w, r) if len(r) else b" ".join(w).decode() for w, r in zip(split, found, strict=True)],
            ]

        return run

    return map_texts(df, text, keep or ["doc_id"], fields, make, others)

"""Quality classifier: naive Bayes support vectors on n-gram indicators.

A text is the set of its n-grams: one to three neighbouring word shapes (case, last character, whether
the word repeats the one before) and three neighbouring bytes, hashed. Each indicator is scaled by the
log-count ratio of the two classes, each text to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent. Its weights are drawn towards their mean size, as usual for this model. A
sigmoid fitted on cross-fitted margins turns a margin into the probability of label 1.

The model is fitted on at most ``SAMPLE`` labelled rows outside the held-out fifth, those with the
smallest hash of the id; that bounds what the driver reads. Whole texts of all documents are scored.
Labels, language, source and id are never inputs of a score.

Null and empty texts have the indicator of the empty text and a score. Rows that repeat are scored each.
Labels that are null are not learned from; an id labelled twice counts with its smaller label. Without
rows of both classes every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import map_texts

#: Labelled rows that a fit reads at most.
SAMPLE = 8_000
#: Score from which a document is kept.
KEEP_FROM = 0.3
SHAPES = 64
PAIRS, TRIPLES, BYTES = SHAPES, SHAPES + SHAPES**2, SHAPES + SHAPES**2 + SHAPES**3
BYTE_BITS = 16
WIDTH = BYTES + (1 << BYTE_BITS)
SMOOTH, COST, EPOCHS, FOLDS, MIX = 1.0, 1.0, 30, 3, 0.25
LAST = {".": 1, ",": 2, "!": 3, "?": 3, "%": 4, "#": 5, "$": 6, "&": 7, "*": 8, "|": 9, ";": 10, ":": 10, ")": 11, '"': 11}
REMEMBERED = 200_000


def shape(word: str) -> int:
    """Code below SHAPES / 2 from the case of a word and its last character."""
    last = word[-1]
    end = LAST.get(last, 0 if last.isalpha() else 12 if last.isdigit() else 13)
    case = 1 if len(word) > 2 and word.isupper() else 0
    return case * 16 + end


def extractor() -> Callable[[str], np.ndarray]:
    """Function that gives the sorted distinct indicator numbers of a text."""
    known: dict[str, int] = {}
    seen = np.zeros(1 << BYTE_BITS, bool)

    def features(text: str) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
        words = text.split()
        for w in set(words):
            if w not in known:
                known[w] = shape(w)
        code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        repeated = np.fromiter(map(str.__eq__, words[1:], words), bool, max(0, len(words) - 1))
        code[1:] += repeated * (SHAPES // 2)
        parts = [
            np.unique(code), PAIRS + np.unique(code[:-1] * SHAPES + code[1:]),
            TRIPLES + np.unique((code[:-2] * SHAPES + code[1:-1]) * SHAPES + code[2:]),
        ]
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
        if len(raw) > 2:
            h = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BYTE_BITS)
            seen[h] = True
            hit = np.flatnonzero(seen)
            seen[hit] = False
            parts.append(BYTES + hit)
        return np.concatenate(parts).astype(np.int32)

    return features


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of the L1-loss support vector machine by dual coordinate descent; the last is the bias."""
    w = np.zeros(WIDTH + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            slope = y[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), COST)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[at] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    bias = w[-1]
    w = (1 - MIX) * np.abs(w[:-1]).mean() * np.sign(w[:-1]) + MIX * w[:-1]
    return np.append(w / MIX, bias)


def sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by damped Newton steps on smoothed targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    loss = lambda a, b: np.logaddexp(0, a * margin + b).sum() - (target * (a * margin + b)).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margin**2).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size, now = 1.0, loss(a, b)
        while size > 1e-4 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(g).max() < 1e-5:
            break
    return float(a), float(b)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, at: np.ndarray) -> float:
        r = self.ratio[at]
        size = np.sqrt(r @ r)
        return float((r @ self.weight[at]) / size + self.bias) if size else self.bias

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(at) + self.offset, -50, 50))))


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """Model of indicator rows with labels 0 and 1."""
    n1, n = int(label.sum()), len(label)
    if not 0 < n1 < n:
        share = (n1 + 1) / (n + 2)
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, float(np.log(share / (1 - share))))

    def one(train: np.ndarray) -> Model:
        counts = np.full((2, WIDTH), SMOOTH)
        for i in train:
            counts[label[i], rows[i]] += 1
        counts /= counts.sum(axis=1, keepdims=True)
        ratio = np.log(counts[1] / counts[0])
        values = []
        for i in train:
            v = ratio[rows[i]]
            values.append(v / max(np.sqrt(v @ v), 1e-12))
        w = descend([rows[i] for i in train], values, 2.0 * label[train] - 1)
        return Model(ratio, w[:-1], float(w[-1]), 1.0, 0.0)

    fold = np.empty(n, int)
    for c in (0, 1):
        of = np.flatnonzero(label == c)
        fold[of] = np.arange(len(of)) % FOLDS
    margin = np.zeros(n)
    for k in range(FOLDS):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if 0 < label[train].sum() < len(train):
            m = one(train)
            margin[test] = [m.margin(rows[i]) for i in test]
    whole = one(np.arange(n))
    whole.slope, whole.offset = sigmoid_fit(margin, label)
    return whole


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Model from at most ``sample`` labelled rows whose id is not held out."""
    usable = labels.where(~held_out(doc_id) & F.col(f"`{label}`").isin(0, 1) & F.col(f"`{doc_id}`").isNotNull())
    marks = usable.groupBy(F.col(f"`{doc_id}`").alias("_fl_id")).agg(F.min(F.col(f"`{label}`").cast("int")).alias("_fl_label"))
    chosen = marks.orderBy(F.xxhash64("_fl_id"), "_fl_id").limit(sample)  # at most ``sample`` rows, so they may be broadcast
    drawn = docs.select(F.col(f"`{doc_id}`").alias("_fl_id"), F.col(f"`{text}`").alias("_fl_t")).join(F.broadcast(chosen), "_fl_id")

    def make() -> Callable[[list[str]], list[list]]:
        features = extractor()
        return lambda texts: [[features(t) for t in texts]]

    found = map_texts(drawn, "_fl_t", ["_fl_id", "_fl_label"], [T.StructField("_fl_at", T.ArrayType(T.IntegerType()))], make)
    # Rows that repeat an id are one training row, so that the bound holds.
    got = found.groupBy("_fl_id").agg(F.min_by("_fl_at", F.xxhash64("_fl_at")).alias("_fl_at"), F.min("_fl_label").alias("_fl_label")).toArrow()
    order = np.argsort(got.column("_fl_id").to_numpy(), kind="stable")
    rows = [v.values.to_numpy() for v in got.column("_fl_at").combine_chunks()]
    return fit([rows[i] for i in order], got.column("_fl_label").to_numpy().astype(int)[order])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` and the score of every row."""
    ratio, weight = model.ratio.astype(np.float32), model.weight.astype(np.float32)
    rest = (model.bias, model.slope, model.offset)

    def make() -> Callable[[list[str]], list[list]]:
        m, features = Model(ratio, weight, *rest), extractor()
        return lambda texts: [[m.score(features(t)) for t in texts]]

    return map_texts(docs, text, keep or ["doc_id"], [T.StructField(name, T.DoubleType())], make)

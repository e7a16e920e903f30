"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Base spans come from three patterns. The battery looks at every maximal run of token characters of at
least ``MIN_RUN``: it infers the encoding, and asks two questions. Is the run as uneven as words and
identifiers of that length are? The chi-squared distance from a uniform alphabet and the number of changes
between classes of symbols answer, joined into one tail probability under text. Is it consistent with random symbols? Chi-squared, runs and serial-correlation
tests answer, and each may refuse. The tail probabilities of all runs of the corpus go through a
Benjamini-Hochberg step within classes of length, so that a long run does not lend its certainty to
short ones. The step needs only a histogram of fixed size, which Spark sums over all documents.

Null and empty texts have no spans. Rows that repeat are reported each. Runs of any length are tested
whole. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import long_field, map_texts, string_field

#: Patterns of the base spans: fixed values, kinds in order of rank.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS = 8, 16

MIN_RUN = 20
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}")
#: Size of the alphabet of an encoding, and the distance of ordinary text from uniform, per symbol.
ENCODINGS = {"hex": (16, 0.6), "base32": (32, 1.0), "base36": (36, 1.3), "base62": (62, 2.5), "base64": (64, 2.6)}
#: Share of neighbouring symbols of different class (lower, upper, digit) in words and identifiers.
CHANGES = 0.2
FALSE_DISCOVERY = 0.001
REFUSE = 0.001
#: Longest run that is remembered.
REMEMBERED_CHARS = 256
#: Histogram of the tail probabilities: steps of their negative decimal logarithm.
STEP, TOP = 0.05, 60.0


def encoding(run: str) -> str | None:
    """The narrowest usual encoding; None for numbers and words, which are no keys."""
    body = run.rstrip("=")
    if not any(c.isdigit() for c in body) or body.isdigit():
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return "hex"
    if re.fullmatch(r"[A-Z2-7]+", body):
        return "base32"
    if re.fullmatch(r"[a-z0-9]+|[A-Z0-9]+", body):
        return "base36"
    return "base62" if body.isalnum() else "base64"


def upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees by the cube-root normal form."""
    if x <= 0:
        return 1.0
    s = 2 / (9 * k)
    return upper_normal(((x / k) ** (1 / 3) - (1 - s)) / math.sqrt(s))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of k or more of n."""
    if k <= 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k, n + 1)]
    return min(1.0, sum(map(math.exp, log)))


def fisher(p: float, q: float) -> float:
    """Two tail probabilities as one."""
    half = -math.log(max(p, 1e-30)) - math.log(max(q, 1e-30))
    return math.exp(-half) * (1 + half)


def battery(run: str) -> tuple[float, float] | None:
    """(tail probability under text, least p-value of the randomness tests), None if no encoding fits."""
    return short_battery(run) if len(run) <= REMEMBERED_CHARS else full_battery(run)


def full_battery(run: str) -> tuple[float, float] | None:
    kind = encoding(run)
    if kind is None:
        return None
    k, distance = ENCODINGS[kind]
    body = run.rstrip("=")
    n = len(body)
    counts = [body.count(c) for c in set(body)]
    chi = sum(c * c for c in counts) * k / n - n
    mean, var = k - 1 + n * distance, 2 * (k - 1) + 4 * n * distance
    even = upper_normal((mean - chi) / math.sqrt(var))
    classes = [0 if c.islower() else 1 if c.isupper() else 2 for c in body if c.isalnum()]
    changes = sum(x != y and (x, y) != (1, 0) for x, y in zip(classes, classes[1:]))  # a capital may begin a word
    text = fisher(even, binomial_tail(changes, len(classes) - 1, CHANGES))
    codes = [ord(c) for c in body]
    middle = sorted(codes)[n // 2]
    up = [c >= middle for c in codes]
    a, b = sum(up), n - sum(up)
    least = chi_tail(chi, k - 1)
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(up, up[1:]))
        mu = 2 * a * b / n + 1
        sd = math.sqrt(max(1e-9, (mu - 1) * (mu - 2) / (n - 1)))
        least = min(least, 2 * upper_normal(abs(runs - mu) / sd))
    m = sum(codes) / n
    spread = sum((c - m) ** 2 for c in codes)
    if spread:
        serial = sum((x - m) * (y - m) for x, y in zip(codes, codes[1:])) / spread
        least = min(least, 2 * upper_normal(abs(serial + 1 / n) * math.sqrt(n)))
    return text, least


#: Verdicts on short runs that a task remembers: some tens of MB at most.
short_battery = lru_cache(maxsize=100_000)(full_battery)


def candidates(text: str) -> list[tuple[int, int, float, float]]:
    out = []
    for m in RUN.finditer(text):
        if (p := battery(m[0])) is not None:
            out.append((m.start(), m.end(), *p))
    return out


def length_class(n: int) -> int:
    return min(12, n.bit_length())


def bin_of(p: float) -> int:
    return int(min(TOP, -math.log10(p)) / STEP)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base patterns, in order."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def random_spans(text: str, cutoffs: dict[int, int], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs that pass the battery and touch no base span."""
    out = []
    for start, end, p, least in candidates(text):
        if least >= REFUSE and bin_of(p) >= cutoffs.get(length_class(end - start), 1 << 30):
            if not any(s < end and start < e for s, _, e in base):
                out.append((start, 3, end))
    return out


def cutoffs(df: DataFrame, text: str = "text") -> dict[int, int]:
    """For each class of length the least bin that the Benjamini-Hochberg step lets through.

    The corpus is read once; what comes to the driver is a histogram of at most 13 x 1,201 bins.
    """
    def make() -> Callable[[list[str]], list[list]]:
        return lambda texts: [[[length_class(b - a) * 10_000 + bin_of(p) for t in texts for a, b, p, _ in candidates(t)]] + [[]] * (len(texts) - 1)]

    found = map_texts(df, text, [], [T.StructField("_fl_bin", T.ArrayType(T.IntegerType()))], make)
    counts = found.select(F.explode("_fl_bin").alias("_fl_bin")).groupBy("_fl_bin").count().collect()
    out = {}
    for c in {r[0] // 10_000 for r in counts}:
        bins = sorted(((r[0] % 10_000, r[1]) for r in counts if r[0] // 10_000 == c), reverse=True)
        total, seen = sum(n for _, n in bins), 0
        for b, n in bins:
            seen += n
            if 10 ** (-b * STEP) <= FALSE_DISCOVERY * seen / total:
                out[c] = b
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep``, ``spans`` (kind:start:end of all, by start and kind) and the counts and digest of the base spans."""
    limits = cutoffs(df, text)

    def make() -> Callable[[list[str]], list[list]]:
        def scan(texts: list[str]) -> list[list]:
            rows = []
            for t in texts:
                base = base_spans(t)
                every = sorted(base + random_spans(t, limits, base))
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), digest, joined(every)))
            return [list(c) for c in zip(*rows, strict=True)]
        return scan

    fields = [long_field("n_assign"), long_field("n_access"), long_field("n_hex"), string_field("base_sha256"), string_field("spans")]
    return map_texts(df, text, keep or ["doc_id"], fields, make)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and the text without its secrets; a null text stays null."""
    limits = cutoffs(df, text)

    def make() -> Callable[[list[str]], list[list]]:
        def scan(texts: list[str]) -> list[list]:
            out = []
            for t in texts:
                base = base_spans(t)
                out.append(mask(t, sorted(base + random_spans(t, limits, base))))
            return [out]
        return scan

    kept = [*(keep or ["doc_id"])]
    blank = df.withColumn("_fl_null", F.col(f"`{text}`").isNull())
    out = map_texts(blank, text, [*kept, "_fl_null"], [string_field("_fl_masked")], make)
    return out.select(*[f"`{c}`" for c in kept], F.when(~F.col("_fl_null"), F.col("_fl_masked")).alias(text))

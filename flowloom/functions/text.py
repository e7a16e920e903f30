"""Label text and column-name normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.numeric import as_column


def normalise_name(name: str) -> str:
    """Compare column names without outer blanks and letter case."""
    return name.strip().lower()


def strip_label(c: Column | str) -> Column:
    """Remove every kind of outer whitespace, tabs and no-break blanks included."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    """Pseudo-random but layout-independent order of rows: md5 of seed and key."""
    parts = [F.lit(f"{seed}|") if i == 0 else F.lit("|") for i in range(len(keys))]
    texts = [c for sep, k in zip(parts, keys) for c in (sep, as_column(k).cast("string"))]
    return F.md5(F.concat(*texts))

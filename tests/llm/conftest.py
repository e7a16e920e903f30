import random

import pytest
from llm_helpers import DOCS, prose
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing extra columns."""
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (1, 2, 3, 4, 5, 30, 200)]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[6], "en", "src1", 1), (101, texts[6] + " x", "en", None, 1), (7, None, None, None, None), (8, "", "en", "src0", 0)]
    rows += [(None, texts[5], "en", "src0", 3), (9, " \t\n ", "en", "src0", 4), (5, texts[5], "en", "src0", 9), (5, texts[5], "en", "src0", 9)]
    rows += [(2**60 + 1, prose(rng, 30_000), "en", "src2", 0), (11, "a b c \U0001f600 İK", "en", "src2", 9)]
    # Columns with the operators' own names must not matter.
    extra = ["n_tokens", "score", "spans", "item_id", "bin", "labels", "_fl_text", "component_id"]
    schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in extra]])
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

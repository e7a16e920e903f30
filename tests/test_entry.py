"""The entry module stands without the optional subpackage and without what that needs."""

import importlib
import sys

import pytest

import __spark_entry__
from flowloom.workload import QUERIES, SQL


@pytest.mark.parametrize("blocked", ["flowloom.llm", "public_tokenizers", "regex", "xxhash", "corpus_pipeline"])
def test_other_queries_stand(monkeypatch, blocked):
    for name in [m for m in sys.modules if m.startswith("flowloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, blocked, None)
    importlib.invalidate_caches()
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert set(QUERIES) <= set(__spark_entry__.queries())
        assert set(SQL) <= set(__spark_entry__.oracle_sql())

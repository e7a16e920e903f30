"""Queries over the given tables, each next to its SQL twin where SQL can say the same."""

from flowloom.workload import attribution, audit, counters, curves, labels, metrics, report, sampling, sources, stats, wavelet  # noqa: F401
from flowloom.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

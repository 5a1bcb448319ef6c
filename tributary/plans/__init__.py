"""Registered queries: operators applied to the given tables."""

from tributary.plans import dataflow, graphs, mining, sources, values  # noqa: F401
from tributary.plans.registry import QUERIES, statements

__all__ = ["QUERIES", "statements"]

"""All registered queries and their oracles."""

from __future__ import annotations

from . import coverage_queries, graph_queries, quality_queries, retrieval_queries, text_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries."""

from __future__ import annotations

from sparkweft.plans import feature_queries, file_queries, log_queries, source_queries, table_queries, vector_queries
from sparkweft.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "feature_queries", "file_queries", "log_queries", "source_queries", "table_queries",
    "vector_queries",
]

"""Imports all modules that register queries."""

from . import catalog_queries, classify_queries, column_queries, discovery_queries, graph_queries, quality_queries, relate_queries, resolve_queries, store_queries, type_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

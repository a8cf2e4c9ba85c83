"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import analysis_queries, factor_queries, order_queries, scan_queries, source_queries, spread_queries, streaming_queries, tree_queries

QUERIES, ORACLE = {}, {}
for _part in (factor_queries, analysis_queries, order_queries, scan_queries, spread_queries, source_queries, streaming_queries, tree_queries):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE

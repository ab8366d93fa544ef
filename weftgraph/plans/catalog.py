"""Every registered query, with its SQL oracle where SQL can express it."""

from __future__ import annotations

from weftgraph.plans import graph_queries, markup_queries, page_oracles, page_queries, saved_queries, store_queries

_PARTS = ((graph_queries.QUERIES, graph_queries.ORACLES), (page_queries.QUERIES, page_oracles.ORACLES), (store_queries.QUERIES, store_queries.ORACLES), (saved_queries.QUERIES, saved_queries.ORACLES), (markup_queries.QUERIES, markup_queries.ORACLES))


def queries() -> dict:
    return {name: query for found, _ in _PARTS for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for _, found in _PARTS for name, sql in found.items()}

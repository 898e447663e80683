"""All queries of the core with the SQL that gives the same rows."""

from __future__ import annotations

from . import crawl, datasets, hot, indexes, pagerank, quality, scalars, search, streams, tables

_MODULES = (hot, datasets, tables, scalars, indexes, quality, pagerank, search, crawl, streams)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

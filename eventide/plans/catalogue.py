"""All queries of the engine, and their SQL for DuckDB."""

from __future__ import annotations

from . import object_queries, reader_queries, report_queries, review_queries, signal_queries, source_queries

MODULES = [signal_queries, object_queries, review_queries, report_queries, reader_queries, source_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}

"""All registered queries of the engine's own operators."""

from __future__ import annotations

from . import corpus_queries, retrieval_queries, session_queries

MODULES = (retrieval_queries, corpus_queries, session_queries)

QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}

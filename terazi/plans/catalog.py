"""Every registered core query with the SQL that gives the same rows."""

from __future__ import annotations

from terazi.plans import retrieval_queries, table_queries, text_queries

_MODULES = (text_queries, retrieval_queries, table_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: s for m in _MODULES for name, s in m.ORACLE_SQL.items()}
flagship = retrieval_queries.fused_questions

"""The queries of the retrieval engine by name, each with the SQL that checks it."""

from __future__ import annotations

from sparkloom.plans import queries_cases, queries_catalog, queries_chunk, queries_retrieval, queries_text

_FAMILIES = (queries_retrieval, queries_text, queries_catalog, queries_chunk, queries_cases)
QUERIES = {k: q for family in _FAMILIES for k, q in family.QUERIES.items()}
ORACLE_SQL = {k: q for family in _FAMILIES for k, q in family.ORACLE_SQL.items()}
FLAGSHIP = "search"

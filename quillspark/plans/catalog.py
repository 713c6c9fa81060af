"""Registry of the library's queries and their DuckDB counterparts."""

from __future__ import annotations

from quillspark.plans import card_queries, final_queries, review_queries, rule_queries, sequence_queries, source_queries, state_queries, text_queries

_PARTS = (card_queries, rule_queries, final_queries, text_queries, review_queries, sequence_queries, source_queries, state_queries)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL = {name: s for part in _PARTS for name, s in part.ORACLE_SQL.items()}

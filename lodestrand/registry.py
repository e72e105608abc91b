"""Queries by name, with the SQL that DuckDB runs to check them."""

from __future__ import annotations

from lodestrand.plans import evidence_queries, index_queries, patch_queries, version_queries

FLAGSHIP = "token_topk"
_PARTS = (index_queries, patch_queries, evidence_queries, version_queries)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}

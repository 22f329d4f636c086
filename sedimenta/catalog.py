"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from sedimenta.plans import q_facts, q_graph, q_more, q_names, q_ops, q_parse, q_reason, q_resolve, q_retrieve, q_scope, q_search, q_text  # noqa: F401  (each registers its queries)
from sedimenta.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

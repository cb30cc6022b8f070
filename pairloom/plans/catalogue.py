"""All of the engine's queries, and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE_SQL, QUERIES, Query, query

FLAGSHIP = "text_profile_by_language"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "Query", "query"]

for _module in ("text_queries", "identity_queries", "quality_queries", "measure_queries", "relation_queries", "explore_queries", "inference_queries", "contract_queries", "stream_queries"):
    import_module(f"pairloom.plans.{_module}")

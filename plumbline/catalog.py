"""Registered queries of the retrieval engine and their SQL equivalents."""

from __future__ import annotations

from plumbline.plans.oracle import oracle_sql
from plumbline.plans.queries import queries

FLAGSHIP = "bm25_top5"

__all__ = ["FLAGSHIP", "oracle_sql", "queries"]

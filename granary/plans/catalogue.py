"""Every query of the engine by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import agent_queries, document_queries, platform_queries, retrieval_queries, scoring_queries, source_queries, stream_queries, text_queries, usage_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

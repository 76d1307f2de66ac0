"""Queries of the engine's own operators, with the SQL that each is compared with."""

from lathe.plans import batch_queries, record_queries, scoring_queries, stream_queries, text_queries, training_queries  # noqa: F401
from lathe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

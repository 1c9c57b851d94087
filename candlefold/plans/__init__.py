"""Registered queries over the reference operators, with their oracle SQL."""

from candlefold.plans import hygiene_queries, indicator_queries, join_queries, score_queries, stat_queries, stream_queries, trade_queries  # noqa: F401
from candlefold.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

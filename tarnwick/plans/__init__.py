"""Registered queries of the engine."""

from tarnwick.plans import chunk_queries, feed_queries, grid_queries, retrieval_queries, text_queries
from tarnwick.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chunk_queries", "feed_queries", "grid_queries", "retrieval_queries", "text_queries"]

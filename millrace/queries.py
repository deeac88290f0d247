"""All registered queries of the library and their SQL."""

from millrace import live_queries, plan_queries, queue_queries, trail_queries
from millrace.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "live_queries", "plan_queries", "queue_queries", "trail_queries"]

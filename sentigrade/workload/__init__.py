"""Views over the test tables and the queries registered for checking and timing."""

from . import queries_aggregates, queries_learning, queries_tables  # noqa: F401
from .registry import QUERIES, check_text, run_query

__all__ = ["QUERIES", "check_text", "run_query"]

"""All registered queries."""

from markspan.plans import (  # noqa: F401
    queries_answers,
    queries_events,
    queries_marking,
    queries_model,
    queries_pages,
    queries_reports,
    queries_storage,
    queries_stream,
    queries_text,
)
from markspan.plans.registry import REGISTRY, spark_queries, sql_queries

__all__ = ["REGISTRY", "spark_queries", "sql_queries"]

from .core import QUERIES, Query
from . import observations, scope_queries, model_queries, report_queries, raw_queries  # noqa: F401

__all__ = ["QUERIES", "Query"]

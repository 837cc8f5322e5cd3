"""Queries over the test tables, by name, with their SQL."""

from . import article_queries, operator_queries, relational_queries, scalar_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "article_queries", "operator_queries", "relational_queries", "scalar_queries", "text_queries"]

"""Imports every module that registers queries."""

from corvane.plans import analytics_queries, answer_queries, lifecycle_queries, handler_queries, question_queries, retrieval_queries, route_queries, sheet_queries, term_queries, text_queries  # noqa: F401

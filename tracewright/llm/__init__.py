"""Operators for preparing training text, with their registered queries."""

from tracewright.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

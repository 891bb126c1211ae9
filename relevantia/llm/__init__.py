"""Operators for training-data pipelines; nothing else in the library imports this package."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

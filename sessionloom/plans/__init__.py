"""Registered queries: each ties an operator to the given tables and to its SQL check."""

from .registry import load_all, oracle_sql, queries

__all__ = ["load_all", "oracle_sql", "queries"]

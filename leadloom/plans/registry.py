"""Registered queries of the core engine and their SQL."""

from leadloom.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""Registered transit queries and their SQL."""

from headway.plans.oracle import ORACLE_SQL
from headway.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

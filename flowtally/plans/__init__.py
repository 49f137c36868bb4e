"""Registered queries and their oracle SQL."""

from flowtally.plans.catalog import QUERIES
from flowtally.plans.oracle import ORACLE_SQL
from flowtally.plans.views import register_query_views

__all__ = ["QUERIES", "ORACLE_SQL", "register_query_views"]

"""Readers for the input tables and writers for result tables."""

from flowtally.sources.bucketed import open_bucketed, write_bucketed
from flowtally.sources.sinks import write_result
from flowtally.sources.tables import TABLE_SCHEMAS, TABLES, check_tables, load_table, load_tables, register_views
from flowtally.sources.warehouse import read_warehouse_query

__all__ = [
    "TABLE_SCHEMAS",
    "TABLES",
    "check_tables",
    "load_table",
    "load_tables",
    "open_bucketed",
    "register_views",
    "write_bucketed",
    "write_result",
    "read_warehouse_query",
]

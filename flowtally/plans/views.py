"""Expose the registered queries to Spark SQL as temporary views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from flowtally.plans.catalog import QUERIES

# Running a stream is an action, so these are not registered unless asked for.
STREAMING = ("streaming_daily_counts", "streaming_sessions", "streaming_attribution")


def register_query_views(
    spark: SparkSession, table_dir: str, names: Iterable[str] | None = None
) -> list[str]:
    """Create a temp view per query, so dashboards can
    ``spark.sql("SELECT ... FROM nation_flows ...")`` and Catalyst optimizes
    the view together with the outer query.  Nothing runs until a view is read,
    but for three queries that run a job when they are set up: the ranks of
    ``value_quantiles``, the interval lengths of ``error_followups`` and the
    number of lines of ``nation_flows``."""
    chosen = list(names) if names is not None else [n for n in QUERIES if n not in STREAMING]
    for name in chosen:
        QUERIES[name](spark, table_dir).createOrReplaceTempView(name)
    return chosen

"""The registered queries: name -> (spark, table_dir) -> DataFrame.

Each query reads whole driver tables from ``table_dir`` and applies one
operator; the parameters below are the dashboard's fixed settings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally import operators as ops
from flowtally.operators.rollup_store import STORED
from flowtally.session import unique_dir
from flowtally.sources import load_table, load_tables
from flowtally.sources.bucketed import write_bucketed
from flowtally.sources.tables import table_path

# Dashboard settings shared with the oracle SQL.
PIVOT_CATEGORIES = ("click", "error", "purchase", "signup", "view")
PERIOD_START = "2024-01-08 00:00:00"
PERIOD_END = "2024-01-15 00:00:00"
PERIOD_CATEGORIES = ("purchase", "signup")
JSON_KEY = "k"
QUANTILE_PROBS = (0.25, 0.5, 0.75, 0.95)
MARKED_CATEGORY, MARK_CATEGORY = "purchase", "view"
CAUSE_CATEGORY = "error"
FOLLOWUP_MICROS = 3_600_000_000
SESSION_GAP_MICROS = 1_800_000_000
STREAM_CAUSE, STREAM_EFFECT = "click", "purchase"
HEAVY_ONE_IN = 133
FUNNEL_STEPS = ("view", "click", "purchase")
FUNNEL_MICROS = 86_400_000_000
CHANGE_BEFORE = ("2024-01-01 00:00:00", PERIOD_START)
CHANGE_AFTER = (PERIOD_START, PERIOD_END)
FLOW_BUCKETS = 16  # at least
TOP_USERS = 10
TOP_USERS_PER_CATEGORY = 3
MOVING_DAYS = 7

Query = Callable[[SparkSession, str], DataFrame]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "events")


def _on_events(op: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return op(_events(spark, d))

    run.__name__ = getattr(op, "__name__", "query")
    return run


def nation_flows(spark: SparkSession, d: str) -> DataFrame:
    t = load_tables(spark, d, "lineitem", "orders", "customer", "supplier", "nation")
    return ops.nation_flows(t["lineitem"], t["orders"], t["customer"], t["supplier"], t["nation"])


def bucketed_nation_flows(spark: SparkSession, d: str) -> DataFrame:
    """``nation_flows`` over lines and orders that were written by order key,
    in buckets that hold about as many lines however large the tables are."""
    t = load_tables(spark, d, "lineitem", "orders", "customer", "supplier", "nation")
    buckets = max(FLOW_BUCKETS, ops.line_partitions(t["lineitem"]))
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        path = unique_dir(spark, f"bucketed-{name}")
        table = f"flowtally_{path.rsplit('/', 1)[-1]}"
        t[name] = write_bucketed(t[name], table, path, [key], buckets)
        spark.sql(f"DROP TABLE {table}")  # the files stay, and the plan knows their buckets
    return ops.nation_flows(t["lineitem"], t["orders"], t["customer"], t["supplier"], t["nation"], bucketed=True)


def weekly_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    path = unique_dir(spark, "user-sketches")
    ops.store_user_sketches(_events(spark, d), path)
    return ops.distinct_users(ops.stored_user_sketches(spark, path), "week")


def incremental_hourly_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Hourly totals made in two refreshes: the days before ``PERIOD_START``,
    then the days after them, for which the first ones are not read again."""
    source, path = unique_dir(spark, "events-by-day"), unique_dir(spark, "hourly")
    dated = _events(spark, d).where("ts IS NOT NULL").withColumn("dt", F.to_date("ts").cast("string"))
    early = F.col("ts") < F.lit(PERIOD_START).cast("timestamp_ntz")
    for part in (early, ~early):
        dated.where(part).repartition("dt").write.mode("append").partitionBy("dt").parquet(source)
        ops.refresh_hourly_rollup(spark, source, path)
    stored = ops.stored_rollup(spark, path)
    return ops.hourly_totals(spark.createDataFrame([], STORED) if stored is None else stored)


def streaming_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    from flowtally.streaming import run_daily_counts

    # One state partition per core of the cluster (defaultParallelism).
    return run_daily_counts(
        spark, table_path(d, "events"), state_partitions=spark.sparkContext.defaultParallelism
    )


def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    from flowtally.streaming.sessions import run_sessions

    parts = spark.sparkContext.defaultParallelism
    return run_sessions(spark, table_path(d, "events"), gap=SESSION_GAP_MICROS, state_partitions=parts).drop("closed")


def streaming_attribution(spark: SparkSession, d: str) -> DataFrame:
    from flowtally.streaming.attribution import run_attribution

    parts = spark.sparkContext.defaultParallelism
    return run_attribution(spark, table_path(d, "events"), STREAM_CAUSE, STREAM_EFFECT, FOLLOWUP_MICROS, state_partitions=parts)


QUERIES: dict[str, Query] = {
    "kpi_totals": _on_events(ops.kpi_totals),
    "activity_by_day": _on_events(lambda df: ops.activity_by_period(df, "day")),
    "activity_by_week": _on_events(lambda df: ops.activity_by_period(df, "week")),
    "activity_by_month": _on_events(lambda df: ops.activity_by_period(df, "month")),
    "category_share": _on_events(ops.category_share),
    "daily_category_pivot": _on_events(lambda df: ops.category_pivot(df, PIVOT_CATEGORIES)),
    "cumulative_activity": _on_events(ops.cumulative_activity),
    "moving_average_7": _on_events(lambda df: ops.moving_average(df, MOVING_DAYS)),
    "day_over_day_change": _on_events(ops.day_over_day_change),
    "new_and_active_users": _on_events(ops.new_and_active_users),
    "top_users": _on_events(lambda df: ops.top_users(df, TOP_USERS)),
    "top_users_per_category": _on_events(lambda df: ops.top_users_per_category(df, TOP_USERS_PER_CATEGORY)),
    "value_bands": _on_events(ops.value_bands),
    "value_quantiles": _on_events(lambda df: ops.exact_quantiles(df, "event_type", "value", QUANTILE_PROBS)),
    "nation_flows": nation_flows,
    "weekday_hour_heatmap": _on_events(ops.weekday_hour_heatmap),
    "json_key_counts": _on_events(lambda df: ops.json_key_counts(df, JSON_KEY)),
    "weekly_retention": _on_events(ops.weekly_retention),
    "filtered_period": _on_events(
        lambda df: ops.filtered_period(df, PERIOD_START, PERIOD_END, PERIOD_CATEGORIES)
    ),
    "day_category_rollup": _on_events(ops.day_category_rollup),
    "gap_filled_daily": _on_events(ops.gap_filled_daily),
    "streaming_daily_counts": streaming_daily_counts,
    "last_view_before_purchase": _on_events(lambda df: ops.last_before(df, MARKED_CATEGORY, MARK_CATEGORY)),
    "error_followups": _on_events(lambda df: ops.followups(df, CAUSE_CATEGORY, FOLLOWUP_MICROS)),
    "user_sessions": _on_events(lambda df: ops.user_sessions(df, SESSION_GAP_MICROS)),
    "streaming_sessions": streaming_sessions,
    "streaming_attribution": streaming_attribution,
    "weekly_distinct_users": weekly_distinct_users,
    "heavy_users": _on_events(lambda df: ops.heavy_hitters(df, "user_id", HEAVY_ONE_IN)),
    "user_category_changes": _on_events(lambda df: ops.pair_changes(df, CHANGE_BEFORE, CHANGE_AFTER)),
    "purchase_funnel": _on_events(lambda df: ops.ordered_funnel(df, FUNNEL_STEPS, FUNNEL_MICROS)),
    "bucketed_nation_flows": bucketed_nation_flows,
    "incremental_hourly_rollup": incremental_hourly_rollup,
}

"""DataFrame-in, DataFrame-out analytics operators."""

from flowtally.operators.aggregates import (
    activity_by_period,
    category_pivot,
    category_share,
    day_category_rollup,
    filtered_period,
    json_key_counts,
    kpi_totals,
    value_bands,
    weekday_hour_heatmap,
)
from flowtally.operators.asof import asof_join, last_before
from flowtally.operators.changes import pair_changes, rows_added, rows_removed, table_changes
from flowtally.operators.flows import line_partitions, line_revenue_units, nation_flows
from flowtally.operators.funnel import ordered_funnel
from flowtally.operators.heavy import heavy_hitters
from flowtally.operators.intervals import followups, interval_join, overlap_join
from flowtally.operators.quantiles import exact_quantiles
from flowtally.operators.rollup_store import hourly_totals, period_totals, refresh_hourly_rollup, stored_rollup
from flowtally.operators.series import (
    cumulative_activity,
    daily_activity,
    day_over_day_change,
    gap_filled_daily,
    moving_average,
)
from flowtally.operators.sessions import user_sessions
from flowtally.operators.sketches import (
    distinct_sketches,
    distinct_users,
    estimated,
    merge_sketches,
    store_user_sketches,
    stored_user_sketches,
)
from flowtally.operators.users import (
    new_and_active_users,
    top_users,
    top_users_per_category,
    weekly_retention,
)

__all__ = [
    "activity_by_period",
    "asof_join",
    "category_pivot",
    "category_share",
    "cumulative_activity",
    "daily_activity",
    "day_category_rollup",
    "day_over_day_change",
    "distinct_sketches",
    "distinct_users",
    "estimated",
    "exact_quantiles",
    "filtered_period",
    "followups",
    "gap_filled_daily",
    "heavy_hitters",
    "hourly_totals",
    "interval_join",
    "json_key_counts",
    "kpi_totals",
    "last_before",
    "line_partitions",
    "line_revenue_units",
    "merge_sketches",
    "moving_average",
    "nation_flows",
    "new_and_active_users",
    "ordered_funnel",
    "overlap_join",
    "pair_changes",
    "period_totals",
    "refresh_hourly_rollup",
    "rows_added",
    "rows_removed",
    "store_user_sketches",
    "stored_rollup",
    "stored_user_sketches",
    "table_changes",
    "top_users",
    "top_users_per_category",
    "user_sessions",
    "value_bands",
    "weekday_hour_heatmap",
    "weekly_retention",
]

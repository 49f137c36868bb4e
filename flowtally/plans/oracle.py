"""Independent DuckDB SQL for every registered query (same column names and
types), used as the correctness oracle on the same Parquet tables."""

from __future__ import annotations

from flowtally.plans.catalog import (
    CAUSE_CATEGORY,
    CHANGE_AFTER,
    CHANGE_BEFORE,
    FOLLOWUP_MICROS,
    FUNNEL_MICROS,
    FUNNEL_STEPS,
    HEAVY_ONE_IN,
    JSON_KEY,
    MARK_CATEGORY,
    MARKED_CATEGORY,
    MOVING_DAYS,
    PERIOD_CATEGORIES,
    PERIOD_END,
    PERIOD_START,
    PIVOT_CATEGORIES,
    QUANTILE_PROBS,
    SESSION_GAP_MICROS,
    STREAM_CAUSE,
    STREAM_EFFECT,
    TOP_USERS,
    TOP_USERS_PER_CATEGORY,
)

AMT = "CAST(value AS DECIMAL(18,2))"
VOL = f"CAST(sum({AMT}) AS DOUBLE)"


def _in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _period(grain: str) -> str:
    if grain == "day":
        return "CAST(ts AS DATE)"
    return f"CAST(date_trunc('{grain}', CAST(ts AS DATE)) AS DATE)"


_DAILY = f"""
    d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n_events, sum({AMT}) AS vol
          FROM events WHERE ts IS NOT NULL GROUP BY 1)"""

_FILLED = _DAILY + """,
    b AS (SELECT min(day) AS lo, max(day) AS hi FROM d),
    cal AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
    f AS (SELECT cal.day, coalesce(d.n_events, 0) AS n_events,
                 CASE WHEN d.day IS NULL THEN CAST(0 AS DECIMAL(18,2)) ELSE d.vol END AS vol
          FROM cal LEFT JOIN d ON cal.day = d.day)"""

_PAIRS_DAY = """
    p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day
          FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""

_PAIRS_WEEK = """
    p AS (SELECT DISTINCT user_id, CAST(date_trunc('week', CAST(ts AS DATE)) AS DATE) AS week
          FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""

_BANDS = (
    (0, "unknown", "value IS NULL"),
    (1, "under_10", "value < 10"),
    (2, "10_to_50", "value < 50"),
    (3, "50_to_100", "value < 100"),
    (4, "100_to_250", "value < 250"),
)


def _band_case(pick: int) -> str:
    whens = " ".join(
        f"WHEN {cond} THEN " + (str(order) if pick == 0 else f"'{label}'")
        for order, label, cond in _BANDS
    )
    return f"CASE {whens} ELSE " + ("5" if pick == 0 else "'250_and_over'") + " END"


def _quantile_cols() -> str:
    from flowtally.operators.quantiles import _prob_label

    return ", ".join(
        f"round(quantile_cont(value, {p}), 4) AS {_prob_label(p)}" for p in QUANTILE_PROBS
    )


def _activity(grain: str) -> str:
    return f"""
SELECT {_period(grain)} AS bucket_start, count(*) AS n_events, {VOL} AS volume
FROM events GROUP BY 1"""


_SECONDS = "CAST(epoch_us({}) - epoch_us({}) AS DOUBLE) / 1e6"

_SESSIONS = f"""
WITH e AS (SELECT user_id, ts, value, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > {SESSION_GAP_MICROS} AS brk
           FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, count_if(coalesce(brk, false)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events, {VOL} AS volume
FROM s GROUP BY user_id, session"""


def _funnel() -> str:
    ctes = ["e AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"]
    ctes.append(f"s1 AS (SELECT user_id, t AS t0, t FROM e WHERE event_type = '{FUNNEL_STEPS[0]}')")
    for k, step in enumerate(FUNNEL_STEPS[1:], 2):
        ctes.append(
            f"s{k} AS (SELECT DISTINCT p.user_id, p.t0, e.t FROM s{k - 1} p JOIN e ON e.user_id = p.user_id"
            f" AND e.event_type = '{step}' AND e.t > p.t AND e.t - p.t0 <= {FUNNEL_MICROS})"
        )
    counts = " UNION ALL ".join(
        f"SELECT {k} AS step, '{step}' AS category, count(DISTINCT user_id) AS n_users FROM s{k}" for k, step in enumerate(FUNNEL_STEPS, 1)
    )
    return f"""
WITH {", ".join(ctes)}, c AS ({counts})
SELECT step, category, n_users, CAST(n_users AS DOUBLE) * 100.0 / CAST(nullif((SELECT n_users FROM c WHERE step = 1), 0) AS DOUBLE) AS pct_of_first
FROM c"""


def _pairs_in(period: tuple[str, str], sign: int) -> str:
    return f"SELECT user_id, event_type, {sign} AS s FROM events WHERE ts >= TIMESTAMP '{period[0]}' AND ts < TIMESTAMP '{period[1]}'"


ORACLE_SQL: dict[str, str] = {
    "kpi_totals": f"""
SELECT count(*) AS n_events, {VOL} AS volume, count(DISTINCT user_id) AS n_users,
       max(value) AS max_value, min(CAST(ts AS DATE)) AS first_day,
       max(CAST(ts AS DATE)) AS last_day
FROM events""",
    "activity_by_day": _activity("day"),
    "activity_by_week": _activity("week"),
    "activity_by_month": _activity("month"),
    "category_share": f"""
WITH c AS (SELECT event_type, count(*) AS n_events, sum({AMT}) AS vol FROM events GROUP BY 1),
     t AS (SELECT CAST(sum(vol) AS DOUBLE) AS total FROM c)
SELECT event_type, n_events, CAST(vol AS DOUBLE) AS volume,
       CAST(vol AS DOUBLE) * CAST(100 AS DOUBLE) / nullif(t.total, 0) AS share_pct
FROM c, t""",
    "daily_category_pivot": "SELECT CAST(ts AS DATE) AS day, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{c}') AS n_{c}" for c in PIVOT_CATEGORIES)
    + f", count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN ({_in_list(PIVOT_CATEGORIES)})) AS n_other"
    + " FROM events GROUP BY 1",
    "cumulative_activity": f"""
WITH {_DAILY}
SELECT day, n_events,
       CAST(sum(n_events) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_events,
       CAST(sum(vol) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum_volume
FROM d""",
    "moving_average_7": f"""
WITH {_FILLED}
SELECT day, n_events,
       avg(n_events) OVER (ORDER BY day ROWS BETWEEN {MOVING_DAYS - 1} PRECEDING AND CURRENT ROW) AS avg_events_{MOVING_DAYS}d
FROM f""",
    "day_over_day_change": f"""
WITH {_FILLED},
    g AS (SELECT day, n_events, lag(n_events) OVER (ORDER BY day) AS prev_n_events FROM f)
SELECT day, n_events, prev_n_events,
       CAST(n_events - prev_n_events AS DOUBLE) * CAST(100 AS DOUBLE)
           / CAST(nullif(prev_n_events, 0) AS DOUBLE) AS pct_change
FROM g""",
    "new_and_active_users": f"""
WITH {_PAIRS_DAY},
    a AS (SELECT day, count(*) AS active_users FROM p GROUP BY day),
    n AS (SELECT first_day AS day, count(*) AS first_time_users
          FROM (SELECT user_id, min(day) AS first_day FROM p GROUP BY user_id) GROUP BY 1)
SELECT a.day, a.active_users, coalesce(n.first_time_users, 0) AS first_time_users,
       a.active_users - coalesce(n.first_time_users, 0) AS returning_users
FROM a LEFT JOIN n ON a.day = n.day""",
    "top_users": f"""
WITH u AS (SELECT user_id, count(*) AS n_events, sum({AMT}) AS vol
           FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT CAST(row_number() OVER (ORDER BY vol DESC NULLS LAST, user_id) AS INTEGER) AS "rank",
       user_id, n_events, CAST(vol AS DOUBLE) AS volume
FROM u ORDER BY vol DESC NULLS LAST, user_id LIMIT {TOP_USERS}""",
    "top_users_per_category": f"""
WITH u AS (SELECT event_type, user_id, count(*) AS n_events, sum({AMT}) AS vol
           FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY event_type
                                        ORDER BY vol DESC NULLS LAST, user_id) AS rn FROM u)
SELECT event_type, CAST(rn AS INTEGER) AS "rank", user_id, n_events, CAST(vol AS DOUBLE) AS volume
FROM r WHERE rn <= {TOP_USERS_PER_CATEGORY}""",
    "value_bands": f"""
SELECT {_band_case(0)} AS band_order, {_band_case(1)} AS band,
       count(*) AS n_events, {VOL} AS volume
FROM events GROUP BY 1, 2""",
    "value_quantiles": f"""
SELECT event_type, count(value) AS n_values, {_quantile_cols()}
FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "nation_flows": """
SELECT cn.n_name AS src_nation, sn.n_name AS dst_nation, count(*) AS n_lines,
       count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT o_custkey) AS n_customers,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN nation sn ON s_nationkey = sn.n_nationkey
GROUP BY 1, 2""",
    "weekday_hour_heatmap": f"""
SELECT CAST(isodow(ts) AS INTEGER) AS iso_weekday, CAST(hour(ts) AS INTEGER) AS hour,
       count(*) AS n_events, {VOL} AS volume
FROM events GROUP BY 1, 2""",
    "json_key_counts": f"""
SELECT CASE WHEN regexp_full_match(raw, '-?[0-9]+') THEN TRY_CAST(raw AS INTEGER) END AS key_value,
       count(*) AS n_events, {VOL} AS volume
FROM (SELECT *, CASE WHEN json_valid(props) THEN json_extract_string(props, '$."{JSON_KEY}"') END AS raw
      FROM events)
GROUP BY 1""",
    "weekly_retention": f"""
WITH {_PAIRS_WEEK},
    c AS (SELECT user_id, min(week) AS cohort_week FROM p GROUP BY user_id),
    t AS (SELECT c.cohort_week, CAST((p.week - c.cohort_week) / 7 AS INTEGER) AS week_offset,
                 count(*) AS active_users
          FROM p JOIN c ON p.user_id = c.user_id GROUP BY 1, 2),
    s AS (SELECT *, max(CASE WHEN week_offset = 0 THEN active_users END)
                        OVER (PARTITION BY cohort_week) AS cohort_users FROM t)
SELECT cohort_week, week_offset, active_users, cohort_users,
       CAST(active_users AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(nullif(cohort_users, 0) AS DOUBLE) AS retention_pct
FROM s""",
    "filtered_period": f"""
SELECT event_type, count(*) AS n_events, {VOL} AS volume, count(DISTINCT user_id) AS n_users
FROM events
WHERE ts >= TIMESTAMP '{PERIOD_START}' AND ts < TIMESTAMP '{PERIOD_END}'
  AND event_type IN ({_in_list(PERIOD_CATEGORIES)})
GROUP BY event_type""",
    "day_category_rollup": f"""
SELECT day, event_type, CAST(GROUPING(day, event_type) AS INTEGER) AS grouping_level,
       count(*) AS n_events, CAST(sum(amt) AS DOUBLE) AS volume
FROM (SELECT CAST(ts AS DATE) AS day, event_type, {AMT} AS amt FROM events)
GROUP BY ROLLUP (day, event_type)""",
    "gap_filled_daily": f"""
WITH {_FILLED}
SELECT day, n_events, CAST(vol AS DOUBLE) AS volume FROM f""",
    "streaming_daily_counts": f"""
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_events, {VOL} AS volume
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "last_view_before_purchase": f"""
SELECT p.event_id, p.user_id, p.ts, v.event_id AS last_event_id, v.ts AS last_ts, {_SECONDS.format('p.ts', 'v.ts')} AS seconds_since
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = '{MARKED_CATEGORY}') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events
                WHERE event_type = '{MARK_CATEGORY}' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL) v
ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "error_followups": f"""
SELECT c.event_id AS cause_id, e.event_id, e.event_type, {_SECONDS.format('e.ts', 'c.ts')} AS seconds_after
FROM events c JOIN events e ON e.user_id = c.user_id AND e.ts >= c.ts AND epoch_us(e.ts) < epoch_us(c.ts) + {FOLLOWUP_MICROS} AND e.event_id <> c.event_id
WHERE c.event_type = '{CAUSE_CATEGORY}'""",
    "user_sessions": _SESSIONS,
    "streaming_sessions": _SESSIONS,
    "streaming_attribution": f"""
SELECT c.user_id, c.event_id AS cause_id, e.event_id AS effect_id, c.ts AS cause_ts, e.ts AS effect_ts
FROM events c JOIN events e ON e.user_id = c.user_id AND e.ts >= c.ts AND epoch_us(e.ts) < epoch_us(c.ts) + {FOLLOWUP_MICROS}
WHERE c.event_type = '{STREAM_CAUSE}' AND e.event_type = '{STREAM_EFFECT}'""",
    "weekly_distinct_users": f"""
SELECT {_period('week')} AS bucket_start, event_type, count(DISTINCT user_id) AS distinct_users
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "heavy_users": f"""
SELECT user_id, count(*) AS n_rows, CAST(count(*) AS DOUBLE) * 100.0 / CAST((SELECT count(user_id) FROM events) AS DOUBLE) AS share_pct
FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) * {HEAVY_ONE_IN} > (SELECT count(user_id) FROM events)""",
    "user_category_changes": f"""
SELECT user_id, event_type, CAST(sum(s) AS BIGINT) AS n_added
FROM ({_pairs_in(CHANGE_BEFORE, -1)} UNION ALL {_pairs_in(CHANGE_AFTER, 1)}) GROUP BY 1, 2 HAVING sum(s) <> 0""",
    "purchase_funnel": _funnel(),
    "incremental_hourly_rollup": f"""
SELECT CAST(ts AS DATE) AS day, event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n_events, {VOL} AS volume
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3""",
}
ORACLE_SQL["bucketed_nation_flows"] = ORACLE_SQL["nation_flows"]

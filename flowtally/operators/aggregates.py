"""Single-table aggregates over an activity table.

An activity table has a timestamp, an actor, a category and an amount
(``events``: ``ts``, ``user_id``, ``event_type``, ``value``).  Every
operator here is built on hash aggregations: Spark aggregates partially
inside each scan task and shuffles only the partial rows, so a category or
user holding a third of the rows costs no more shuffle than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.functions import (
    cents,
    event_day,
    exact_sum,
    finite,
    from_cents,
    iso_weekday,
    json_int,
    period_start,
    value_band,
    value_band_order,
)


def _count() -> F.Column:
    return F.count(F.lit(1)).alias("n_events")


def kpi_totals(df: DataFrame, ts: str = "ts", user: str = "user_id", value: str = "value") -> DataFrame:
    """One row: events, exact volume, distinct actors, largest finite value,
    first and last active day."""
    day = event_day(ts)
    return df.agg(
        _count(),
        exact_sum(value).alias("volume"),
        F.countDistinct(user).alias("n_users"),
        F.max(finite(value)).alias("max_value"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )


def activity_by_period(df: DataFrame, grain: str = "day", ts: str = "ts", value: str = "value") -> DataFrame:
    """Events and volume per day, ISO week (starting Monday) or month."""
    return df.groupBy(period_start(ts, grain).alias("bucket_start")).agg(
        _count(), exact_sum(value).alias("volume")
    )


def category_share(df: DataFrame, category: str = "event_type", value: str = "value") -> DataFrame:
    """Volume per category and its percent of the total volume.

    The total is a window sum over the per-category rows: the events are
    scanned and aggregated once, and the window's single partition holds one
    row per category (a dimension), never the events.  A scalar subquery
    would read the table a second time, because column pruning makes its
    aggregate differ from the main one and the shuffle is not reused.
    """
    per_cat = df.groupBy(category).agg(_count(), F.sum(cents(value)).alias("_vol"))
    volume = from_cents("_vol")
    total = from_cents(F.sum("_vol").over(Window.partitionBy()))
    return per_cat.select(
        category,
        "n_events",
        volume.alias("volume"),
        F.try_divide(volume * F.lit(100.0), total).alias("share_pct"),
    )


def category_pivot(
    df: DataFrame,
    categories: Sequence[str],
    ts: str = "ts",
    category: str = "event_type",
) -> DataFrame:
    """Events per day with one ``n_<category>`` column per listed category and
    ``n_other`` for the rest (null categories included), so the columns of a
    day add up to its events.

    The categories are listed by the caller so Spark does not run a separate
    job to find them.
    """
    if not categories:
        raise ValueError("list at least one category to pivot")
    if "other" in categories:
        raise ValueError("n_other holds the unlisted categories; rename the category 'other'")
    listed = F.coalesce(F.col(category).isin(list(categories)), F.lit(False))
    return df.groupBy(event_day(ts).alias("day")).agg(
        *[F.count_if(F.col(category) == c).alias(f"n_{c}") for c in categories],
        F.count_if(~listed).alias("n_other"),
    )


def value_bands(df: DataFrame, value: str = "value") -> DataFrame:
    """Events and volume per fixed value band (see ``VALUE_BANDS``)."""
    return df.groupBy(
        value_band_order(value).alias("band_order"), value_band(value).alias("band")
    ).agg(_count(), exact_sum(value).alias("volume"))


def weekday_hour_heatmap(df: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Events per ISO weekday (1 = Monday) and hour of day."""
    return df.groupBy(
        iso_weekday(ts).alias("iso_weekday"), F.hour(ts).cast("int").alias("hour")
    ).agg(_count(), exact_sum(value).alias("volume"))


def json_key_counts(df: DataFrame, key: str, json_col: str = "props", value: str = "value") -> DataFrame:
    """Events per integer value of one top-level JSON key; malformed or
    missing values fall in the null group."""
    return df.groupBy(json_int(json_col, key).alias("key_value")).agg(
        _count(), exact_sum(value).alias("volume")
    )


def filtered_period(
    df: DataFrame,
    start: str,
    end: str,
    categories: Sequence[str],
    ts: str = "ts",
    user: str = "user_id",
    category: str = "event_type",
    value: str = "value",
    partition_day: str | None = None,
) -> DataFrame:
    """Per-category events, volume and distinct actors for ``start <= ts <
    end`` (``'YYYY-MM-DD[ HH:MM:SS]'``, no zone) and the listed categories.

    Bounds are TIMESTAMP_NTZ literals, the column's own type, so both
    predicates reach the Parquet scan as pushed filters and row groups outside
    the range are skipped.  For a table stored partitioned by the event's
    calendar day, name that column in ``partition_day``: a (conservative)
    day-range predicate on it lets Spark skip whole partitions, and the
    ``ts`` predicate still decides each row.
    """
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end).cast("timestamp_ntz")
    cond = (F.col(ts) >= lo) & (F.col(ts) < hi) & F.col(category).isin(list(categories))
    if partition_day is not None:
        day = F.col(partition_day)
        cond = cond & (day >= F.to_date(lo)) & (day <= F.to_date(hi))
    return (
        df.where(cond)
        .groupBy(category)
        .agg(_count(), exact_sum(value).alias("volume"), F.countDistinct(user).alias("n_users"))
    )


def day_category_rollup(
    df: DataFrame, ts: str = "ts", category: str = "event_type", value: str = "value"
) -> DataFrame:
    """Events and volume per (day, category), per day, and in total.

    ``grouping_level`` tells subtotal rows from rows whose key is null in the
    data: 0 = day and category, 1 = day subtotal, 3 = grand total.  The rows
    are first aggregated to (day, category) and only that small result is
    rolled up, so the three-fold row expansion of ROLLUP never touches the
    raw table.
    """
    fine = df.groupBy(event_day(ts).alias("day"), F.col(category).alias(category)).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(cents(value)).alias("_vol")
    )
    return fine.rollup("day", category).agg(
        F.grouping_id().cast("int").alias("grouping_level"),
        F.sum("_n").alias("n_events"),
        from_cents(F.sum("_vol")).alias("volume"),
    )

"""Daily series: gap filling, running totals, moving averages, changes.

Each operator first aggregates the activity table to one row per day (a
distributed, partially aggregated hash aggregation).  The ordered window
functions then run on that daily result, whose size is the number of
calendar days in the data (a few thousand rows for a decade), not the number
of events; that is why their un-partitioned windows are acceptable here and
would not be on raw rows.  Every operator scans the events once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.functions import cents, event_day, from_cents


def _daily_exact(df: DataFrame, ts: str, value: str) -> DataFrame:
    """day, n_events, _vol (cents) for days with at least one event; rows
    without a timestamp belong to no day and are left out."""
    return df.where(F.col(ts).isNotNull()).groupBy(event_day(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(cents(value)).alias("_vol")
    )


def _filled_exact(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Daily rows from the first to the last active day, idle days as zeros.

    Each active day is followed by the idle days up to the next active day
    (``lead``), so the calendar comes from the daily rows themselves: the
    events are scanned and aggregated once, with no second branch for the
    date bounds.
    """
    next_day = F.lead("day").over(Window.orderBy("day"))
    last = F.coalesce(F.date_sub(F.col("_next"), 1), F.col("day"))
    return (
        _daily_exact(df, ts, value)
        .withColumn("_next", next_day)
        .select(F.explode(F.sequence("day", last)).alias("_d"), "day", "n_events", "_vol")
        .select(
            F.col("_d").alias("day"),
            F.when(F.col("_d") == F.col("day"), F.col("n_events")).otherwise(F.lit(0)).alias("n_events"),
            F.when(F.col("_d") == F.col("day"), F.col("_vol")).otherwise(F.lit(0).cast("long")).alias("_vol"),
        )
    )


def daily_activity(df: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """day, n_events, volume for the days with activity."""
    return _daily_exact(df, ts, value).select(
        "day", "n_events", from_cents("_vol").alias("volume")
    )


def gap_filled_daily(df: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """day, n_events, volume for every day from the first to the last active
    day; days without events have zeros."""
    return _filled_exact(df, ts, value).select(
        "day", "n_events", from_cents("_vol").alias("volume")
    )


def cumulative_activity(df: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Running event count and running volume by day (active days)."""
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _daily_exact(df, ts, value).select(
        "day",
        "n_events",
        F.sum("n_events").over(upto).alias("cum_events"),
        from_cents(F.sum("_vol").over(upto)).alias("cum_volume"),
    )


def moving_average(df: DataFrame, days: int = 7, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean daily events over the ``days`` calendar days ending on each day
    (days without events count as zero; the first days of the series average
    over the days available)."""
    if days < 1:
        raise ValueError("days must be at least 1")
    last_n = Window.orderBy("day").rowsBetween(-(days - 1), Window.currentRow)
    return _filled_exact(df, ts, value).select(
        "day",
        "n_events",
        F.avg("n_events").over(last_n).alias(f"avg_events_{days}d"),
    )


def day_over_day_change(df: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Events per calendar day, the previous day's events, and the change in
    percent (null on the first day and after a day with no events)."""
    prev = F.lag("n_events").over(Window.orderBy("day"))
    filled = _filled_exact(df, ts, value)
    return filled.select("day", "n_events", prev.alias("prev_n_events")).select(
        "day",
        "n_events",
        "prev_n_events",
        F.try_divide(
            (F.col("n_events") - F.col("prev_n_events")).cast("double") * F.lit(100.0),
            F.col("prev_n_events").cast("double"),
        ).alias("pct_change"),
    )

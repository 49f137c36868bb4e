"""Actor-centric operators: new versus active actors, cohort retention,
top actors.

Everything starts from each actor's set of days or weeks.  The sets are
built inside each scan task before the shuffle, so a single actor
with a third of all rows sends at most one row per day per task.  Rows with
a null actor are left out of every actor count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.functions import cents, from_cents, period_start


def _actor_periods(df: DataFrame, user: str, ts: str, grain: str, name: str) -> DataFrame:
    """``(name, first)``: a row for each actor's distinct period, with the
    actor's first one.  One shuffle: an actor's periods are gathered as a set,
    which the calendar bounds and each task pre-aggregates."""
    return (
        df.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(user))
        .agg(F.collect_set(period_start(ts, grain)).alias("_periods"))
        .select(F.array_min("_periods").alias("first"), F.explode("_periods").alias(name))
    )


def new_and_active_users(df: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Per active day: distinct active actors, actors seen for the first time,
    and returning actors (active minus first-time).  The events are scanned
    and shuffled by actor once."""
    return (
        _actor_periods(df, user, ts, "day", "day")
        .groupBy("day")
        .agg(
            F.count(F.lit(1)).alias("active_users"),
            F.count(F.when(F.col("day") == F.col("first"), F.lit(1))).alias("first_time_users"),
        )
        .withColumn("returning_users", F.col("active_users") - F.col("first_time_users"))
    )


def weekly_retention(df: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Cohort table: actors first seen in ``cohort_week`` who are active
    ``week_offset`` weeks later, the cohort's size and the percentage.

    The cohort size is a window over the cohort's week offsets, a partition
    bounded by the calendar; the events are scanned once.
    """
    counts = (
        _actor_periods(df, user, ts, "week", "week")
        .withColumnRenamed("first", "cohort_week")
        .select(
            "cohort_week",
            (F.datediff("week", "cohort_week") / F.lit(7)).cast("int").alias("week_offset"),
        )
        .groupBy("cohort_week", "week_offset")
        .agg(F.count(F.lit(1)).alias("active_users"))
    )
    size = F.max(F.when(F.col("week_offset") == 0, F.col("active_users"))).over(
        Window.partitionBy("cohort_week")
    )
    return counts.withColumn("cohort_users", size).withColumn(
        "retention_pct",
        F.try_divide(F.col("active_users").cast("double") * F.lit(100.0), F.col("cohort_users").cast("double")),
    )


def _actor_totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(cents(value)).alias("_vol")
    )


def top_users(df: DataFrame, k: int = 10, user: str = "user_id", value: str = "value") -> DataFrame:
    """The ``k`` actors with the largest volume (ties broken by actor id).

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: every task keeps
    its own top ``k`` and only those rows reach the final merge.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    top = (
        _actor_totals(df.where(F.col(user).isNotNull()), [user], value)
        .orderBy(F.col("_vol").desc_nulls_last(), F.col(user).asc())
        .limit(k)
    )
    rank = F.row_number().over(Window.orderBy(F.col("_vol").desc_nulls_last(), F.col(user).asc()))
    return top.select(
        rank.cast("int").alias("rank"), user, "n_events", from_cents("_vol").alias("volume")
    )


def top_users_per_category(
    df: DataFrame,
    k: int = 3,
    user: str = "user_id",
    category: str = "event_type",
    value: str = "value",
) -> DataFrame:
    """The ``k`` actors with the largest volume inside each category.

    ``row_number() <= k`` lets Spark insert a WindowGroupLimit before the
    shuffle, so each task forwards at most ``k`` rows per category and a hot
    category is never gathered whole.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    per = _actor_totals(df.where(F.col(user).isNotNull()), [category, user], value)
    order = Window.partitionBy(category).orderBy(F.col("_vol").desc_nulls_last(), F.col(user).asc())
    return (
        per.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            category,
            F.col("rank").cast("int").alias("rank"),
            user,
            "n_events",
            from_cents("_vol").alias("volume"),
        )
    )

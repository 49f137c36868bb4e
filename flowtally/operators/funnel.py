"""Ordered funnels: how many actors pass steps in order within a time limit.

Each event learns, from the events strictly before it, the latest start from
which it completes the steps so far: a later start never leaves less time, so
one running maximum per step is enough, and a chain of windows over the same
sorted rows does it in one shuffle.

A chain lies within the limit, hence in two neighbouring bins of that length.
Every event goes into the group of its bin and of the next one, so an actor's
rows are spread over groups by time and even the most active one is never
sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_funnel(
    events: DataFrame, steps: Sequence[str], within: int, user: str = "user_id", event_type: str = "event_type", ts: str = "ts"
) -> DataFrame:
    """``(step, category, n_users, pct_of_first)``: the actors with an event of
    each of the first ``step`` categories, each strictly later than the one
    before and the last at most ``within`` microseconds after the first.  Rows
    without actor, time or category are left out; a step nobody reaches has 0."""
    if not steps or within < 1:
        raise ValueError("at least one step, and a limit of a microsecond or more, are needed")
    rows = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull() & F.col(event_type).isin(*set(steps)))
    rows = rows.select(F.col(user).alias("user"), F.col(event_type).alias("category"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    bin_ = F.floor(F.col("at") / F.lit(within))
    rows = rows.withColumn("group", F.explode(F.array(bin_, bin_ + 1)))
    earlier = Window.partitionBy("user", "group").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("s1", F.when(F.col("category") == steps[0], F.col("at")))
    for k, step in enumerate(steps[1:], 2):
        start = F.max(f"s{k - 1}").over(earlier)
        rows = rows.withColumn("start", F.when(F.col("category") == step, start))
        rows = rows.withColumn(f"s{k}", F.when(F.col("at") - F.col("start") <= F.lit(within), F.col("start"))).drop("start")
    # An event is of one step at most, unless a category is repeated; its
    # furthest step counts.
    furthest = F.greatest(F.lit(0), *(F.when(F.col(f"s{k}").isNotNull(), F.lit(k)).otherwise(0) for k in range(1, len(steps) + 1)))
    users = rows.groupBy("user").agg(F.max(furthest).alias("furthest"))
    counts = users.agg(*(F.count_if(F.col("furthest") >= k).alias(f"n{k}") for k in range(1, len(steps) + 1)))
    out = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(step).alias("category"), F.col(f"n{k}").alias("n_users")) for k, step in enumerate(steps, 1)))
    pct = F.try_divide(F.col("x.n_users").cast("double") * F.lit(100.0), F.col("n1").cast("double"))
    return counts.select("n1", F.explode(out).alias("x")).select("x.step", "x.category", "x.n_users", pct.alias("pct_of_first"))

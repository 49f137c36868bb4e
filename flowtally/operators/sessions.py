"""Sessions: runs of an actor's events with no pause longer than a gap.

An actor's time is cut into pieces.  Sessions are found in each piece by
itself, and what is left of a piece is a row per session; these rows are then
merged per actor the same way.  So a very active actor's events are sorted by
as many tasks as it has pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.functions import cents, from_cents
from flowtally.operators.asof import DAY

GAP = 30 * 60 * 1_000_000  # microseconds


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _merged(spans: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """``spans(keys, first, last, n, vol)`` joined where the next begins no
    later than ``gap`` after all before have ended."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("first") - reached > F.lit(gap), F.lit(True)).cast("int")
    numbered = spans.withColumn("_new", new).withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("vol").alias("vol"))


def user_sessions(
    events: DataFrame, gap: int = GAP, user: str = "user_id", ts: str = "ts", value: str = "value", piece: int = DAY
) -> DataFrame:
    """``(user, session_start, session_end, n_events, volume)``: per actor the
    maximal runs of events of which none is more than ``gap`` microseconds
    after the one before; ``session_end`` is the last event's time.  Rows
    without an actor or a time are left out; events at one time are one
    session.  ``piece`` (microseconds) changes the work of a task only."""
    rows = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
    at = _micros(ts)
    spans = rows.select(F.col(user).alias("user"), at.alias("first"), at.alias("last"), F.lit(1).cast("long").alias("n"), cents(value).alias("vol"))
    pieces = spans.withColumn("piece", F.floor(F.col("first") / F.lit(piece)))
    parts = _merged(pieces, ["user", "piece"], gap).select("user", "first", "last", "n", "vol")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return _merged(parts, ["user"], gap).select(
        F.col("user").alias(user), time("first").alias("session_start"), time("last").alias("session_end"), F.col("n").alias("n_events"), from_cents("vol").alias("volume")
    )

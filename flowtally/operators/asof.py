"""As-of join: each row with the latest earlier row of another table.

Both tables are merged into one sequence per key and sorted once; a window
carries the last right row forward to the left rows after it, so no pair of
rows is ever compared (a non-equi join compares all of them per key).

A key's sequence is cut into pieces of fixed length in time, each sorted by
itself; the last right row of every piece is carried over to the key's later
pieces.  So a key that holds a third of all rows is spread over as many tasks
as it has pieces, and what meets per key is one row per piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

DAY = 86_400_000_000  # microseconds


def _number(df: DataFrame, c: str) -> Column:
    """A time column as a long: microseconds (session zone UTC), or the number
    itself for integer columns."""
    if isinstance(df.schema[c].dataType, (DateType, TimestampNTZType, TimestampType)):
        return F.unix_micros(F.col(f"`{c}`").cast("timestamp"))
    return F.col(f"`{c}`").cast("long")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str | None = None,
    ties: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    prefix: str = "",
    direction: str = "backward",
    strict: bool = False,
    tolerance: int | None = None,
    how: str = "left",
    piece: int = 7 * DAY,
) -> DataFrame:
    """Every row of ``left`` with the latest row of ``right`` that has equal
    ``on`` columns and is no later (``direction="forward"``: the earliest no
    earlier).

    ``strict`` leaves out right rows of the same time, ``tolerance`` those
    farther away (in microseconds, or units of an integer time column).  Of
    right rows at one time the one with the greatest ``ties`` wins (nulls
    lowest).  The result has ``left``'s columns and ``columns`` of ``right``
    (all but ``on`` by default), named with ``prefix``; names that clash are
    refused.  Null keys and null times match nothing; ``how="inner"`` drops
    left rows without a match.  ``piece`` is the length of the pieces, in the
    same unit as ``tolerance``; it changes the work of a task, never the result.
    """
    if direction not in ("backward", "forward") or how not in ("left", "inner"):
        raise ValueError("direction is backward or forward, how is left or inner")
    right_time = right_time or left_time
    columns = [c for c in right.columns if c not in on] if columns is None else list(columns)
    names = [f"{prefix}{c}" for c in columns]
    if clash := {n.lower() for n in names} & {c.lower() for c in left.columns}:
        raise ValueError(f"columns {sorted(clash)} are on both sides; pass a prefix")
    sign = F.lit(1 if direction == "backward" else -1)
    picked = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)))
    left_row = F.struct(*(F.col(f"`{c}`") for c in left.columns))

    def side(df: DataFrame, time: str, order: int, row: Column, found: Column, tie: list[Column]) -> DataFrame:
        keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(on)]
        return df.select(*keys, (sign * _number(df, time)).alias("at"), F.lit(order).alias("side"), row.alias("row"), found.alias("found"), F.struct(*tie).alias("tie"))

    tie_types = [right.schema[c].dataType for c in ties]
    found_type = right.select(picked.alias("x")).schema["x"].dataType
    # At equal times the right row comes first, unless it must not match.
    lefts = side(left, left_time, 0 if strict else 1, left_row, F.lit(None).cast(found_type), [F.lit(None).cast(t).alias(f"t{i}") for i, t in enumerate(tie_types)] or [F.lit(0).alias("t")])
    rights = side(right, right_time, 1 if strict else 0, F.lit(None).cast(left.select(left_row.alias("x")).schema["x"].dataType), picked, [F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(ties)] or [F.lit(0).alias("t")])
    keys = [f"k{i}" for i in range(len(on))]
    usable = F.col("at").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    both = lefts.where(usable).unionByName(rights.where(usable)).withColumn("piece", F.floor(F.col("at") / F.lit(piece)))

    # The match's own time travels along, to measure the distance.
    held = F.when(F.col("found").isNotNull(), F.struct("at", "found"))
    order = Window.partitionBy(*keys, "piece").orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("here", F.last(held, ignorenulls=True).over(order)).where(F.col("row").isNotNull())
    last = both.groupBy(*keys, "piece").agg(F.max_by(held, F.when(F.col("found").isNotNull(), F.struct("at", "tie"))).alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "piece", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    matched = here.join(carried, [*keys, "piece"]).withColumn("match", F.coalesce("here", "carried"))
    if tolerance is not None:
        matched = matched.withColumn("match", F.when(F.col("at") - F.col("match.at") <= F.lit(tolerance), F.col("match")))
    out = matched.select("row", F.col("match.found").alias("found"))
    if how == "inner":
        out = out.where(F.col("found").isNotNull())
    else:
        out = out.unionByName(lefts.where(~F.coalesce(usable, F.lit(False))).select("row", "found"))
    return out.select(*(F.col(f"row.`{c}`") for c in left.columns), *(F.col(f"found.`{n}`") for n in names))


def last_before(
    events: DataFrame, category: str, earlier: str, user: str = "user_id", event_type: str = "event_type", ts: str = "ts", event_id: str = "event_id"
) -> DataFrame:
    """Each event of ``category`` with the same actor's latest ``earlier``
    event no later than it (of several at one time, the largest id) and the
    seconds between; nulls where there is none."""
    rows = events.where(F.col(event_type) == category).select(event_id, user, ts)
    marks = events.where(F.col(event_type) == earlier).select(event_id, user, ts)
    joined = asof_join(rows, marks, [user], ts, ties=[event_id], prefix="last_")
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"last_{ts}").cast("timestamp"))
    return joined.withColumn("seconds_since", seconds.cast("double") / F.lit(1e6))

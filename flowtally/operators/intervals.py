"""Range joins: points inside intervals, and intervals that overlap.

An equality join needs equal keys, so time is cut into bins.  An interval is
filed at the level whose bins are at least as long as it, and so lies in one
bin or, replicated at the border, in two; a point is looked up once at each
level that has intervals.  Rows then meet only with what is in their bin, and a
pair meets in exactly one: no pair is made twice and no distinct is needed.
Levels grow by a factor of four, so short and long intervals go together
without long ones being filed in very many bins.

The bins are an ordinary join key: Spark broadcasts the intervals if they are
small, else it sorts and merges, and a crowded bin is split by its skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.operators.asof import DAY, _number

FACTOR = 4
LEVELS = 32  # 4^31 bins' lengths span any long


def _level(length: Column, width: int) -> Column:
    """The first level whose bins are no shorter than ``length``."""
    return sum((F.coalesce(length > F.lit(min(width * FACTOR**k, (1 << 63) - 1)), F.lit(False)).cast("int") for k in range(LEVELS - 1)), F.lit(0))


def _bin(at: Column, level: Column, width: int) -> Column:
    size = F.element_at(F.array(*(F.lit(min(width * FACTOR**k, (1 << 63) - 1)).cast("long") for k in range(LEVELS))), level + 1)
    return F.when(at >= 0, F.call_function("div", at, size)).otherwise(F.call_function("div", at + 1, size) - 1)


def interval_join(
    points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, on: Sequence[str] = (), how: str = "inner", width: int = DAY // 24
) -> DataFrame:
    """Pairs of a row of ``points`` and a row of ``intervals`` with
    ``start <= point < end`` and equal ``on`` columns.

    The result has the columns of ``points`` and those of ``intervals`` but
    ``on``.  Null points, borders and keys match nothing, empty and reversed
    intervals neither; repeated rows pair each.  ``how="left"`` also keeps the
    points without an interval (nulls beside them), ``how="anti"`` keeps only
    those (``points``' columns).  ``width`` is the length of the smallest bins,
    in microseconds or units of an integer column; the length of short
    intervals is best, and it never changes the result.  A small job counts
    which levels the intervals use.
    """
    if how not in ("inner", "left", "anti"):
        raise ValueError("how is inner, left or anti")
    extra = [c for c in intervals.columns if c not in on]
    if clash := {c.lower() for c in extra} & {c.lower() for c in points.columns}:
        raise ValueError(f"columns {sorted(clash)} are on both sides; rename them")
    keys = [f"k{i}" for i in range(len(on))]

    def keyed(df: DataFrame) -> list[Column]:
        return [F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)]

    spans = intervals.select(
        *keyed(intervals), _number(intervals, start).alias("low"), _number(intervals, end).alias("high"), F.struct(*(F.col(f"`{c}`") for c in extra)).alias("span")
    ).where("low < high")
    spans = spans.withColumn("level", _level(F.col("high") - F.col("low"), width))
    used = sorted(r.level for r in spans.select("level").distinct().collect())  # at most LEVELS
    first, last = (_bin(F.col(c) - shift, F.col("level"), width) for c, shift in (("low", 0), ("high", 1)))
    filed = spans.withColumn("bin", F.explode(F.sequence(first, last)))
    rows = points.select(*keyed(points), _number(points, point).alias("at"), F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("row"))
    hit = (F.col("low") <= F.col("at")) & (F.col("at") < F.col("high"))
    own = [F.col(f"row.`{c}`") for c in points.columns]

    def found() -> DataFrame:
        levels = F.explode(F.array(*map(F.lit, used)).cast("array<int>"))
        asked = rows.withColumn("level", levels).withColumn("bin", _bin(F.col("at"), F.col("level"), width))
        return asked.join(filed, [*keys, "level", "bin"]).where(hit).select("row", "span")

    def alone() -> DataFrame:
        rest = rows
        for level in used:
            at_level = filed.where(F.col("level") == level).select(*(F.col(k).alias(f"s_{k}") for k in keys), F.col("bin").alias("s_bin"), "low", "high")
            same = _bin(F.col("at"), F.lit(level), width) == F.col("s_bin")
            for k in keys:
                same = same & (F.col(k) == F.col(f"s_{k}"))
            rest = rest.join(at_level, same & hit, "left_anti")
        return rest.select("row")

    if how == "anti":
        return alone().select(*own)
    pairs = found()
    if how == "left":
        pairs = pairs.unionByName(alone().withColumn("span", F.lit(None).cast(pairs.schema["span"].dataType)))
    return pairs.select(*own, *(F.col(f"span.`{c}`") for c in extra))


def overlap_join(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: Sequence[str] = (), width: int = DAY // 24
) -> DataFrame:
    """Pairs of a row of ``left`` and a row of ``right`` whose half-open spans
    share a moment, with equal ``on`` columns.  Two spans overlap exactly when
    one of them holds the other's start: those of ``right`` starting inside
    ``left``'s, and those of ``left`` starting after ``right``'s and inside it.
    Nulls, empty and reversed spans match nothing."""
    proper = lambda df, span: df.where(F.col(f"`{span[0]}`") < F.col(f"`{span[1]}`"))
    left, right = proper(left, left_span), proper(right, right_span)
    columns = [*(F.col(f"`{c}`") for c in left.columns), *(F.col(f"`{c}`") for c in right.columns if c not in on)]
    inside = interval_join(right, left, right_span[0], *left_span, on=on, width=width).select(*columns)
    after = interval_join(left, right, left_span[0], *right_span, on=on, width=width)
    after = after.where(F.col(f"`{left_span[0]}`") > F.col(f"`{right_span[0]}`")).select(*columns)
    return inside.unionByName(after)


def followups(
    events: DataFrame, category: str, within: int, user: str = "user_id", event_type: str = "event_type", ts: str = "ts", event_id: str = "event_id"
) -> DataFrame:
    """Events of the same actor in the ``within`` microseconds from an event of
    ``category`` on (that one itself left out): ``cause_id``, the event's id
    and category, and the seconds between."""
    causes = events.where(F.col(event_type) == category).select(user, F.col(event_id).alias("cause_id"), F.col(ts).alias("cause_ts"))
    causes = causes.withColumn("until", F.col("cause_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(within / 1e6)))
    rows = events.select(user, event_id, event_type, ts)
    pairs = interval_join(rows, causes, ts, "cause_ts", "until", on=[user], width=within).where(F.col(event_id) != F.col("cause_id"))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("cause_ts").cast("timestamp"))
    return pairs.select("cause_id", event_id, event_type, (seconds.cast("double") / F.lit(1e6)).alias("seconds_after"))

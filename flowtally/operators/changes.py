"""Differences between two versions of a table, as multisets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows (all columns, by name) that one version has more often than
    the other, with ``n_added`` (negative: removed).

    Both versions go through one shuffle, old rows counting -1 and new ones +1;
    equal rows cancel within each task already, so what is shuffled is about
    the number of distinct rows.  Nulls equal nulls, repeated rows count, NaN
    equals NaN.  Versions whose columns differ are refused."""
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(new.columns))}")
    if "n_added" in old.columns:
        raise ValueError("a column is named n_added")
    columns = [f"`{c}`" for c in old.columns]
    signed = old.select(*columns, F.lit(-1).cast("long").alias("n_added")).unionByName(new.select(*columns, F.lit(1).cast("long").alias("n_added")))
    return signed.groupBy(*columns).agg(F.sum("n_added").alias("n_added")).where("n_added <> 0")


def rows_added(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` minus ``old`` as a multiset: each row as often as it was added."""
    return _repeated(table_changes(old, new), 1)


def rows_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return _repeated(table_changes(old, new), -1)


def _repeated(changes: DataFrame, sign: int) -> DataFrame:
    more = changes.where(F.col("n_added") * sign > 0)
    return more.withColumn("n_added", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n_added")))).drop("n_added")


def pair_changes(
    events: DataFrame, before: tuple[str, str], after: tuple[str, str], user: str = "user_id", category: str = "event_type", ts: str = "ts"
) -> DataFrame:
    """How often each (actor, category) occurs more, or less, in the half-open
    period ``after`` than in ``before``; pairs of equal counts are left out."""

    def version(low: str, high: str) -> DataFrame:
        at = F.col(ts)
        return events.where((at >= F.lit(low).cast("timestamp_ntz")) & (at < F.lit(high).cast("timestamp_ntz"))).select(user, category)

    return table_changes(version(*before), version(*after))

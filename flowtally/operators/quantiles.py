"""Exact per-group quantiles (linear interpolation, the ``quantile_cont`` /
``percentile`` definition) without gathering a group in one task.

Spark's ``percentile`` aggregate is exact, but it merges one value->count map
per group in a single task, so a group holding a third of the rows (and most
of the distinct values) must fit one executor's memory.  Here the values are
sorted across the cluster instead:

* equal values of a group are counted (map-side first), and the (group, value)
  counts are range partitioned: each partition is a *piece* of that order, and
  a hot group lies in many pieces, because its counts are all different rows;
* each piece's total per group gives, by a running sum over at most one row per
  partition, how many values of the group lie in earlier pieces;
* only the pieces that hold a wanted rank are read again: a running count
  inside the piece finds the value.

The counts are checkpointed with their piece number in the shared folder, so a
task recomputed after a lost executor finds the same pieces.  This happens when
the function is called; the lookups run with the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.session import shared_dir


def _prob_label(p: float) -> str:
    pct = format(Decimal(str(p)) * 100, "f")
    if "." in pct:
        pct = pct.rstrip("0").rstrip(".")
    return "p" + pct.replace(".", "_")


def _sorted_pieces(df: DataFrame, group: str | None, value: str) -> DataFrame:
    """``(g, v, c, piece)``: how often each finite value of a group occurs, in
    range partitions numbered in the order of (g, v)."""
    v = F.col(value).cast("double")
    counts = (
        df.where(F.abs(v) < F.lit(float("inf")))  # neither null, NaN nor infinite
        # The group travels as a one-field struct: a struct is never null, so
        # the join below matches a null group like any other value.
        .select(F.struct((F.col(group) if group else F.lit(0)).alias("k")).alias("g"), v.alias("v"))
        .groupBy("g", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    shared_dir(df.sparkSession)
    return counts.repartitionByRange("g", "v").withColumn("piece", F.spark_partition_id()).checkpoint()


def _between(lo: Column, hi: Column, frac: Column) -> Column:
    """lo + (hi - lo) * frac, in exact decimals for amounts of up to six
    decimals (rounded to DOUBLE once), else in DOUBLE."""

    def exact(x: Column) -> Column:
        return x.try_cast("decimal(22,6)")

    in_decimals = (exact(lo) + (exact(hi) - exact(lo)) * frac).cast("double")
    fits = (exact(lo).cast("double") == lo) & (exact(hi).cast("double") == hi)
    return F.when(fits, in_decimals).otherwise(lo + (hi - lo) * frac.cast("double"))


def exact_quantiles(
    df: DataFrame,
    group: str | None,
    value: str = "value",
    probs: Sequence[float] = (0.25, 0.5, 0.75, 0.95),
) -> DataFrame:
    """One row per group: ``n_values`` and one column per probability
    (``p50`` for 0.5, ``p99_9`` for 0.999).  Values are taken as DOUBLE, not
    rounded; null, NaN and infinite values are ignored, and a group without
    others has no row.  Probabilities have at most eight decimals.  With
    ``group=None`` the quantiles are taken over all rows (one output row, no
    group column)."""
    probs = list(probs)
    if not probs or any(not 0.0 <= p <= 1.0 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    if len({_prob_label(p) for p in probs}) != len(probs):
        raise ValueError("probabilities must be distinct")
    if any(Decimal(str(p)) != round(Decimal(str(p)), 8) for p in probs):
        raise ValueError("probabilities must have at most eight decimals")

    pieces = _sorted_pieces(df, group, value)
    # Position h = (n - 1) * p in exact DECIMAL; side 0 wants rank floor(h),
    # side 1 rank ceil(h).
    of_group = Window.partitionBy("g")
    totals = (
        pieces.groupBy("g", "piece")
        .agg(F.sum("c").alias("m"))
        .withColumn("n", F.sum("m").over(of_group))
        .withColumn("before", F.sum("m").over(of_group.orderBy("piece")) - F.col("m"))
    )

    def ranks(i: int, p: float) -> list[Column]:
        h = (F.col("n") - 1).cast("decimal(20,0)") * F.lit(Decimal(str(p))).cast("decimal(9,8)")
        frac = (h - F.floor(h)).cast("decimal(9,8)").alias("frac")
        at = (F.floor(h), F.ceil(h))
        return [F.struct(F.lit(i).alias("pi"), F.lit(side).alias("side"), at[side].cast("long").alias("rank"), frac) for side in (0, 1)]

    wanted = F.array(*(r for i, p in enumerate(probs) for r in ranks(i, p)))
    inside = F.filter(wanted, lambda t: (t["rank"] >= F.col("before")) & (t["rank"] < F.col("before") + F.col("m")))
    targets = totals.select("g", "piece", "n", "before", inside.alias("ts")).where(F.size("ts") > 0)

    # A piece of a group is one range partition at most, and a row of
    # ``targets`` has at most two ranks per probability.
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("g", "piece").orderBy("v"))
    found = (
        pieces.join(targets, ["g", "piece"])
        .withColumn("upto", upto)
        .select("g", "n", "v", F.explode(F.filter("ts", lambda t: (t["rank"] >= F.col("upto") - F.col("c")) & (t["rank"] < F.col("upto")))).alias("t"))
    )
    per_group = found.groupBy(F.col("g.k").alias(group or "_all")).agg(
        F.max("n").alias("n_values"),
        *[
            F.max(F.when((F.col("t.pi") == i) & (F.col("t.side") == side), F.col(col))).alias(f"_{name}{i}")
            for i in range(len(probs))
            for side, col, name in ((0, "v", "lo"), (1, "v", "hi"), (0, "t.frac", "fr"))
        ],
    )
    return per_group.select(
        *([group] if group else []),
        "n_values",
        *[_between(F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_fr{i}")).alias(_prob_label(p)) for i, p in enumerate(probs)],
    )

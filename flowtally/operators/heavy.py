"""Heavy hitters: the items that make up more than a given share of all rows.

A task keeps a bounded number of counters (the mergeable summary of Misra and
Gries): a batch's counts are added, and when there are more items than
counters, the count of the first one too many is taken from all.  An item over
1/n of a task's rows always survives with n counters.  An item over 1/n of all
rows is over 1/n of the rows of some task, so the survivors of all tasks hold
every heavy hitter; a second pass counts just these exactly.  Memory does not
depend on the number of distinct items, as a plain ``groupBy`` of all does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Counters:
    """At most ``size`` counters of the most frequent items seen."""

    def __init__(self, size: int):
        self.size, self.count = size, {}

    def add(self, items: list, counts: list[int]) -> None:
        for item, n in zip(items, counts):
            self.count[item] = self.count.get(item, 0) + n
        if len(self.count) > self.size:
            n = np.fromiter(self.count.values(), np.int64, len(self.count))
            less = int(np.partition(n, -self.size - 1)[-self.size - 1])
            self.count = {item: c - less for item, c in self.count.items() if c > less}


def heavy_candidates(df: DataFrame, item: str, one_in: int) -> DataFrame:
    """Items that may make up more than one in ``one_in`` rows of ``df``: all
    that do, and at most ``one_in`` per task."""
    kind = df.schema[item].dataType.simpleString()

    def run(batches):
        counters, arrow = Counters(one_in), None
        for b in batches:
            seen = pc.value_counts(b.column(0).drop_null())
            arrow = b.column(0).type
            counters.add(seen.field("values").to_pylist(), seen.field("counts").to_pylist())
        if counters.count:
            yield pa.RecordBatch.from_arrays([pa.array(list(counters.count), arrow)], ["item"])

    return df.select(F.col(item).alias("item")).mapInArrow(run, f"item {kind}").distinct()


def heavy_hitters(df: DataFrame, item: str = "user_id", one_in: int = 100) -> DataFrame:
    """``(item, n_rows, share_pct)`` of every item that makes up more than one
    in ``one_in`` of the rows that have one; exact.  Null is no item."""
    if one_in < 1:
        raise ValueError("one_in must be at least 1")
    rows = df.where(F.col(item).isNotNull())
    total = rows.count()
    found = rows.join(heavy_candidates(df, item, one_in).withColumnRenamed("item", item), item, "left_semi")
    counted = found.groupBy(item).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") * F.lit(one_in) > F.lit(total))
    return counted.withColumn("share_pct", F.try_divide(F.col("n_rows").cast("double") * F.lit(100.0), F.lit(float(total))))

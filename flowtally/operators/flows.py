"""Source-to-destination flows.

A line item moves value from the nation of the ordering customer (source)
to the nation of the supplier (destination).  The join tree follows the
foreign keys: lineitem -> supplier, orders -> customer, then lineitem ->
orders; each side's nation key is resolved against ``nation`` at the end,
on the 625-row result.

Scale notes:

* Line items have two large foreign-key parents.  When ``supplier`` is too
  big to broadcast, the line items are shuffled twice (by supplier key, then
  by order key); only tables bucketed on those keys avoid that.  Each line
  is reduced to (order key, supplier key, revenue units) before the first
  shuffle.  The per-order aggregation after the join with orders groups by
  the order key (plus columns that depend on it), so it reuses the join's
  partitioning and adds no shuffle.
* Lines and orders meet in ``line_partitions`` tasks of some ``LINES_PER_TASK``
  lines each: the two sorts of the join and the two hash maps of the per-order
  step stand in one task, whose memory so stays the same however large the
  tables are.  (Left to AQE, few large partitions would be made of them.)
* No side is forced into a broadcast.  ``nation`` (25 rows by definition of
  the schema) and, while small, ``supplier`` and ``customer`` fall under
  ``spark.sql.autoBroadcastJoinThreshold``, which checks their size first;
  otherwise they are shuffle joins.  AQE re-plans from measured sizes and
  splits skewed join partitions (a customer with a third of all orders is
  spread over several tasks).
* Revenue is exact and summed in BIGINT only: price and discount in cents
  give each line's revenue in units of 1/10000, summed per order.  A flow's
  total can exceed the BIGINT range at 100 TB, so each order's units are
  split as ``hi * 10^6 + lo`` (``|lo| < 10^6``) and the two parts are summed
  separately; neither sum can overflow below ~9 * 10^12 orders per flow.
  The parts are recombined in DECIMAL on the 625 result rows only (a
  DECIMAL(38,0) sum over the orders keeps its buffer as bytes and made the
  query about twice as slow).
* After the per-order step a row is one (order, destination) pair and an
  order has one source, so distinct orders per flow are a plain row count.
  Distinct customers use Spark's single-distinct plan, which deduplicates
  (flow, customer) pairs with a shuffle on the pair before counting, so one
  flow's customers are never collected in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.functions import cents

REVENUE_SCALE = 10_000
_SPLIT = 1_000_000
LINES_PER_TASK = 500_000


def line_revenue_units() -> F.Column:
    """``l_extendedprice * (1 - l_discount)`` in 1/10000 units, exact for
    prices and discounts with two decimals."""
    return cents("l_extendedprice") * (F.lit(100) - cents("l_discount"))


def line_partitions(lineitem: DataFrame) -> int:
    """Partitions by order key of about ``LINES_PER_TASK`` line items, one per
    core at least.  Counts the rows (from the footers of a Parquet table)."""
    return max(lineitem.sparkSession.sparkContext.defaultParallelism, -(-lineitem.count() // LINES_PER_TASK))


def nation_flows(
    lineitem: DataFrame,
    orders: DataFrame,
    customer: DataFrame,
    supplier: DataFrame,
    nation: DataFrame,
    bucketed: bool = False,
) -> DataFrame:
    """Per (source nation, destination nation): line items, distinct orders,
    distinct customers and exact revenue.  ``bucketed`` lines and orders lie by
    order key already (``write_bucketed``) and are not dealt anew."""
    supp = supplier.select("s_suppkey", F.col("s_nationkey").alias("dst_key"))
    # Revenue units are computed before the first join, so a shuffled line
    # carries three longs instead of two keys and two doubles.
    items = lineitem.select("l_orderkey", "l_suppkey", line_revenue_units().alias("_units"))
    lines = items.join(supp, items.l_suppkey == supp.s_suppkey).select("l_orderkey", "dst_key", "_units")
    cust = customer.select("c_custkey", F.col("c_nationkey").alias("src_key"))
    order_src = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        "o_orderkey", "o_custkey", "src_key"
    )
    if not bucketed:
        parts = line_partitions(lineitem)
        lines, order_src = lines.repartition(parts, "l_orderkey"), order_src.repartition(parts, "o_orderkey")
    per_order = (
        lines.join(order_src, lines.l_orderkey == order_src.o_orderkey)
        .groupBy("l_orderkey", "src_key", "dst_key", "o_custkey")
        .agg(F.count(F.lit(1)).alias("_lines"), F.sum("_units").alias("_units"))
    )
    hi = F.expr(f"_units div {_SPLIT}")
    flows = per_order.groupBy("src_key", "dst_key").agg(
        F.sum("_lines").alias("n_lines"),
        F.count(F.lit(1)).alias("n_orders"),
        F.countDistinct("o_custkey").alias("n_customers"),
        F.sum(hi).alias("_hi"),
        F.sum(F.col("_units") - hi * F.lit(_SPLIT)).alias("_lo"),
    )
    revenue = (
        F.col("_hi").cast("decimal(38,0)") * F.lit(_SPLIT) + F.col("_lo").cast("decimal(38,0)")
    ) / F.lit(REVENUE_SCALE)
    src = nation.select(F.col("n_nationkey").alias("src_key"), F.col("n_name").alias("src_nation"))
    dst = nation.select(F.col("n_nationkey").alias("dst_key"), F.col("n_name").alias("dst_nation"))
    return flows.join(src, "src_key").join(dst, "dst_key").select(
        "src_nation",
        "dst_nation",
        "n_lines",
        "n_orders",
        "n_customers",
        revenue.cast("double").alias("revenue"),
    )

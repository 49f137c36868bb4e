"""Physical-plan properties the operators are designed for."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as contract
from flowtally.plans import QUERIES
from tests.conftest import SF001


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


BATCH = sorted(n for n in QUERIES if n != "streaming_daily_counts")


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_cartesian(spark, name):
    p = plan(contract.queries()[name](spark, SF001))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, bad


def test_filtered_period_pushes_filters(spark):
    p = plan(contract.queries()["filtered_period"](spark, SF001))
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(event_type), GreaterThanOrEqual(ts,2024-01-08T00:00), LessThan(ts,2024-01-15T00:00), In(event_type, [purchase,signup])]" in p or (
        "GreaterThanOrEqual(ts,2024-01-08T00:00)" in p and "LessThan(ts,2024-01-15T00:00)" in p and "In(event_type, [purchase,signup])" in p
    )
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p


def test_scans_read_only_needed_columns(spark):
    p = plan(contract.queries()["nation_flows"](spark, SF001))
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double,l_discount:double>" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p
    p = plan(contract.queries()["activity_by_day"](spark, SF001))
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in p


def test_top_k_is_bounded_before_shuffle(spark):
    assert "TakeOrderedAndProject" in plan(contract.queries()["top_users"](spark, SF001))
    p = plan(contract.queries()["top_users_per_category"](spark, SF001))
    assert "WindowGroupLimit" in p


def test_aggregations_are_partial(spark):
    p = plan(contract.queries()["category_share"](spark, SF001))
    assert "partial_sum" in p and "partial_count" in p


def test_rollup_expands_aggregated_rows_only(spark):
    p = plan(contract.queries()["day_category_rollup"](spark, SF001))
    # the Expand of ROLLUP sits above the first (day, category) aggregation
    assert p.index("Expand") < p.rindex("HashAggregate")


def test_shared_dir_reads_session_setting(spark):
    from flowtally.session import shared_dir

    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_filtered_period_prunes_day_partitions(spark, fixture_dir):
    """On a table partitioned by day, the optional day predicate prunes
    partitions and the result is the same as on the flat table."""
    import os
    import tempfile

    from pyspark.sql import functions as F

    from flowtally import operators as ops
    from flowtally.sources import load_table

    out = tempfile.mkdtemp(prefix="flowtally-partitioned-")
    flat = load_table(spark, fixture_dir, "events")
    flat.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(os.path.join(out, "events.parquet"))
    parted = load_table(spark, out, "events")
    args = ("2024-01-02 12:00:00", "2024-01-10 23:59:59.999999", ["purchase", "view", "signup"])
    got = ops.filtered_period(parted, *args, partition_day="dt")
    want = ops.filtered_period(flat, *args)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    p = plan(got)
    assert "PartitionFilters: [isnotnull(dt" in p and "(dt#" in p


def test_rows_without_timestamp_reconcile(spark, fixture_dir):
    """The null bucket of the daily table is what the running total lacks."""
    from flowtally.plans import QUERIES

    daily = {r.bucket_start: r.n_events for r in QUERIES["activity_by_day"](spark, fixture_dir).collect()}
    undated = daily.pop(None)
    running = max(r.cum_events for r in QUERIES["cumulative_activity"](spark, fixture_dir).collect())
    assert undated > 0 and running == sum(daily.values())
    assert QUERIES["kpi_totals"](spark, fixture_dir).first().n_events == running + undated

"""Results stay exact when one key holds a third of the rows."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile

import pytest

import __spark_entry__ as contract
from flowtally.plans import QUERIES
from tests.fixtures import split_into_files, skewed_event_rows, write_events, write_skewed_flow_tables
from tests.oracle_check import compare, duck_connect

EVENT_QUERIES = sorted(n for n in QUERIES if not n.endswith("nation_flows"))


@pytest.fixture(scope="module")
def skewed_dir():
    d = tempfile.mkdtemp(prefix="flowtally-skew-")
    write_events(os.path.join(d, "events.parquet"), skewed_event_rows())
    write_skewed_flow_tables(d)
    return d


@pytest.fixture(scope="module")
def skew_conf(spark):
    # sort-merge joins everywhere and skew thresholds low enough that the hot
    # partitions count as skewed.  AQE splits a skewed partition by map
    # output blocks, so with one input file per table (one map task) it has
    # nothing to split here; the test checks that results stay exact under
    # these plans; test_hot_join_keys_are_split covers the split itself.
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", EVENT_QUERIES)
def test_skewed_events_match_oracle(spark, skewed_dir, skew_conf, name):
    con = duck_connect(skewed_dir, ["events"])
    assert compare(contract.queries()[name](spark, skewed_dir), con, contract.oracle_sql()[name]) == []


def test_skewed_flows_match_oracle(spark, skewed_dir, skew_conf):
    con = duck_connect(skewed_dir, ["nation", "customer", "supplier", "orders", "lineitem"])
    df = contract.queries()["nation_flows"](spark, skewed_dir)
    assert compare(df, con, contract.oracle_sql()["nation_flows"]) == []


def test_hot_join_keys_are_split(spark):
    """With several map tasks, AQE splits the partitions of the hot supplier
    and the hot customer (sort-merge joins marked skew=true), and the result
    is unchanged."""
    d = tempfile.mkdtemp(prefix="flowtally-skew-split-")
    write_skewed_flow_tables(d)
    for name in ("lineitem", "orders"):
        split_into_files(d, name, 16)
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.files.maxPartitionBytes": "4k",
        "spark.sql.files.openCostInBytes": "1",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = contract.queries()["nation_flows"](spark, d)
        con = duck_connect(d, ["nation", "customer", "supplier", "orders", "lineitem"])
        assert compare(df, con, contract.oracle_sql()["nation_flows"]) == []
        df.collect()  # run this DataFrame itself: explain then shows the final plan
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="formatted")
        plan = buf.getvalue()
        assert "isFinalPlan=true" in plan
        assert plan.count("SortMergeJoin(skew=true)") >= 2, plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

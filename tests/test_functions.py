"""Column helpers and the result sink."""

from __future__ import annotations

import datetime as dt
import os
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowtally.functions import cents, exact_sum, iso_weekday, json_int, period_start, value_band
from flowtally.session import unique_dir
from flowtally.sources import write_result
from tests.conftest import SF0001

MONEY = st.decimals(min_value=Decimal("-1e9"), max_value=Decimal("1e9"), places=2, allow_nan=False, allow_infinity=False)


@settings(max_examples=15, deadline=None)
@given(st.lists(MONEY, min_size=1, max_size=60))
def test_exact_sum_equals_decimal_sum(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.agg(exact_sum("v").alias("s")).first()["s"]
    assert got == float(sum(values))


def test_cents_rounds_half_away_from_zero(spark):
    # two-decimal amounts plus exact binary ties (0.125): half away from zero
    rows = [(0.125,), (-0.125,), (1.005,), (2.67,), (-3.3,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v double").select(cents("v")).collect()]
    want = [None if v is None else int(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP) * 100) for (v,) in rows]
    assert got == want


def test_calendar_helpers(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 7, 23, 59, 59), '{"k": 5}'), (dt.datetime(2024, 2, 29, 0, 0), '{"k": 1.5}')],
        "ts timestamp_ntz, p string",
    )
    r = df.select(
        period_start("ts", "week").alias("w"),
        period_start("ts", "month").alias("m"),
        iso_weekday("ts").alias("dow"),
        json_int("p", "k").alias("k"),
    ).collect()
    assert [(x.w, x.m, x.dow, x.k) for x in r] == [
        (dt.date(2024, 1, 1), dt.date(2024, 1, 1), 7, 5),
        (dt.date(2024, 2, 26), dt.date(2024, 2, 1), 4, None),
    ]


def test_value_band_edges(spark):
    vals = [None, -1.0, 9.99, 10.0, 49.99, 50.0, 100.0, 250.0, 1e9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(value_band("v")).collect()]
    assert got == ["unknown", "under_10", "under_10", "10_to_50", "10_to_50", "50_to_100",
                   "100_to_250", "250_and_over", "250_and_over"]


def test_write_result_replaces_only_written_partitions(spark):
    out = unique_dir(spark, "test-sink")
    a = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "month string, n int")
    write_result(a, out, partition_by=["month"])
    b = spark.createDataFrame([("2024-02", 20)], "month string, n int")
    write_result(b, out, partition_by=["month"])
    got = sorted((r.month, r.n) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01", 1), ("2024-02", 20)]
    assert os.path.isdir(os.path.join(out, "month=2024-01"))



def test_publish_writes_every_requested_table(spark):
    from flowtally.plans.publish import publish
    from tests.conftest import SF0001

    out = unique_dir(spark, "test-publish")
    paths = publish(spark, SF0001, out, ["kpi_totals", "nation_flows"])
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["kpi_totals", "nation_flows"]
    assert spark.read.parquet(paths[0]).count() == 1
    assert spark.read.parquet(paths[1]).count() > 0


def test_declared_schemas_match_the_driver_tables(spark):
    from flowtally.sources import TABLE_SCHEMAS, load_table
    from tests.conftest import SF0001

    for name in TABLE_SCHEMAS:
        declared = load_table(spark, SF0001, name).schema
        inferred = load_table(spark, SF0001, name, infer_schema=True).schema
        assert [(f.name, f.dataType) for f in declared] == [(f.name, f.dataType) for f in inferred], name


def test_operators_reject_bad_parameters(spark):
    import pytest

    from flowtally import operators as ops

    df = spark.createDataFrame([], "ts timestamp_ntz, user_id bigint, event_type string, value double")
    for call in (lambda: ops.moving_average(df, 0), lambda: ops.top_users(df, 0),
                 lambda: ops.top_users_per_category(df, 0), lambda: ops.activity_by_period(df, "year"),
                 lambda: ops.category_pivot(df, [])):
        with pytest.raises(ValueError):
            call()


def test_query_views_serve_spark_sql(spark):
    from flowtally.plans import register_query_views
    from tests.conftest import SF0001

    names = register_query_views(spark, SF0001)
    assert "streaming_daily_counts" not in names and "nation_flows" in names
    top = spark.sql(
        "SELECT src_nation, sum(revenue) AS revenue FROM nation_flows GROUP BY src_nation "
        "ORDER BY revenue DESC LIMIT 3"
    ).collect()
    assert len(top) == 3
    assert spark.sql("SELECT n_events FROM kpi_totals").first()[0] == 1000


def test_warehouse_reader_checks_partitioning_arguments(spark):
    """The JDBC reader itself needs a warehouse (none here); its argument
    check runs before any connection is opened."""
    import pytest

    from flowtally.sources import read_warehouse_query

    with pytest.raises(ValueError):
        read_warehouse_query(spark, "jdbc:none://nowhere", "SELECT 1", partition_column="id")


def test_json_int_reads_whole_texts_and_literal_keys(spark):
    from flowtally.functions import json_int

    cases = {
        '{"k": 7} trailing': None, '{"k":7}{"k":8}': None, "{'k': 7}": None, '{"k":7}][{}': None, '{"k":7}}{': None,
        '{"k":7},"y":1': None, '{"k": 7} ': 7, '{"k":"7"}': 7, '{"k":2.5}': None, "[1]": None, "": None,
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.v for r in df.select("p", json_int("p", "k").alias("v")).collect()} == cases
    dotted = spark.createDataFrame([('{"a":{"b":6},"a.b":5}',)], "p string")
    assert dotted.select(json_int("p", "a.b")).first()[0] == 5


def test_non_finite_amounts_add_nothing(spark):
    from flowtally.functions import exact_sum
    from flowtally.operators import exact_quantiles

    rows = [("g", x) for x in (10.0, float("nan"), float("inf"), float("-inf"), None, -2.5)]
    df = spark.createDataFrame(rows, "g string, value double")
    assert df.agg(exact_sum("value")).first()[0] == 7.5
    got = exact_quantiles(df, group="g", value="value", probs=[0.0, 0.5, 1.0]).first().asDict()
    assert sorted(v for v in got.values() if isinstance(v, float)) == [-2.5, 3.75, 10.0]


def test_pivot_columns_add_up(spark):
    from flowtally import operators as ops

    rows = [("2024-01-01 01:00:00", c) for c in ("a", "a", "x", None, "b")]
    df = spark.createDataFrame(rows, "t string, event_type string").selectExpr("CAST(t AS TIMESTAMP_NTZ) ts", "event_type")
    assert ops.category_pivot(df, ["a", "b"]).select("n_a", "n_b", "n_other").first() == (2, 1, 2)


def test_json_int_flat_objects_and_others(spark):
    """Texts that one look settles, and texts that have to be parsed."""
    from flowtally.functions import json_int

    cases = {
        '{"k": 1}': 1, ' { "a" : "x y" , "k":-7 , "b": null}\n': -7, '{"k": 2, "n": 1.5e-3, "t": true}': 2, '{"k": 3, "a": [1, {"b": 2}]}': 3,
        '{"a": "q\\"uote", "k": 4}': 4, '{"k": 5} {"k": 6}': None, '{"k": 007}': None, '{"k": 8,}': None, '{"k": 9': None, '{"a": "tab\there", "k": 1}': None,
        '{"k": "10"}': 10, '{"k": 1.0}': None, '{"k": 99999999999}': None, "{}": None, "": None, None: None, '{"é": 1, "k": 11}': 11, '{"k": 12}]': None,
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.v for r in df.select("p", json_int("p", "k").alias("v")).collect()} == cases


def test_amounts_that_are_not_finite(spark):
    """They count as rows, and are no volume, no maximum and in no band."""
    from flowtally import operators as ops

    values = [1.0, 20.0, None, float("nan"), float("inf"), -float("inf")]
    df = spark.createDataFrame([(v, 1, "a") for v in values], "value double, user_id long, event_type string").selectExpr("*", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts")
    r = ops.kpi_totals(df).first()
    assert (r.n_events, r.volume, r.max_value) == (6, 21.0, 20.0)
    assert {(r.band, r.n_events, r.volume) for r in ops.value_bands(df).collect()} == {("under_10", 1, 1.0), ("10_to_50", 1, 20.0), ("unknown", 4, None)}


def test_schema_drift_is_found(spark, tmp_path):
    from flowtally.plans.publish import publish
    from flowtally.sources import check_tables

    good = spark.read.parquet(f"{SF0001}/nation.parquet")
    good.withColumn("more", good.n_name).write.parquet(str(tmp_path / "a" / "nation.parquet"))
    check_tables(spark, str(tmp_path / "a"), "nation")
    good.withColumnRenamed("n_name", "name").write.parquet(str(tmp_path / "b" / "nation.parquet"))
    with pytest.raises(ValueError, match="nation lacks n_name string"):
        check_tables(spark, str(tmp_path / "b"), "nation")
    with pytest.raises(ValueError, match="nation lacks"):
        publish(spark, str(tmp_path / "b"), str(tmp_path / "out"), ["kpi_totals"])


def test_intermediate_tables_can_be_cleared(spark):
    import os

    from flowtally.session import clear_intermediate, shared_dir, unique_dir

    spark.range(3).write.parquet(unique_dir(spark, "test-clear"))
    assert os.listdir(shared_dir(spark, "flowtally", "test-clear"))
    clear_intermediate(spark)
    assert not os.path.exists(shared_dir(spark, "flowtally"))
    clear_intermediate(spark)  # nothing is there

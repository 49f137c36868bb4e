"""Sketches, heavy hitters, table changes, funnels, bucketed tables and the
incremental rollup against plain Python."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowtally import operators as ops
from flowtally.operators.heavy import Counters, heavy_candidates
from flowtally.plans import QUERIES
from flowtally.sources.bucketed import open_bucketed, write_bucketed
from tests.conftest import SF0001
from tests.test_plans import plan

T0 = dt.datetime(2024, 3, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- sketches


def test_sketch_error_and_merges(spark):
    """The estimate of 200,000 distinct items is within 3 per cent; merges give
    the same bytes' estimate in any order and any grouping, also with repeats."""
    df = spark.range(600_000).selectExpr("id % 200000 AS u", "id % 30 AS day", "id % 7 AS c")
    sketches = ops.distinct_sketches(df, ["day", "c"], "u", lg_k=14).cache()
    total = lambda s: ops.estimated(s, "n").first().n
    one = total(ops.merge_sketches(sketches))
    assert abs(one / 200_000 - 1) < 0.03
    assert total(ops.merge_sketches(ops.merge_sketches(sketches, ["c"]))) == one
    shuffled = sketches.union(sketches.where("day < 9")).orderBy(F.rand(3))
    assert total(ops.merge_sketches(ops.merge_sketches(shuffled, ["day"]))) == one
    exact = {(r.day, r.c): r.n for r in df.groupBy("day", "c").agg(F.countDistinct("u").alias("n")).collect()}
    got = {(r.day, r.c): r.n for r in ops.estimated(sketches, "n").collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] / exact[k] - 1) < 0.05 for k in exact)
    assert total(ops.merge_sketches(sketches.limit(0))) == 0


def test_stored_sketches_replace_days(spark, tmp_path):
    path = str(tmp_path / "s")
    e = lambda *x: spark.createDataFrame([(T0 + dt.timedelta(days=d) if d is not None else None, c, u) for d, c, u in x], "ts timestamp_ntz, event_type string, user_id long")
    ops.store_user_sketches(e((0, "a", 1), (0, "a", 2), (1, "a", 1), (1, None, 7), (1, "b", None), (None, "a", 9)), path)
    ops.store_user_sketches(e((1, "a", 1), (1, "a", 3), (2, "a", 4)), path)
    stored = ops.stored_user_sketches(spark, path)
    assert {(str(r.bucket_start), r.event_type, r.distinct_users) for r in ops.distinct_users(stored, "month").collect()} == {("2024-03-01", "a", 4)}
    assert "PartitionFilters: [isnotnull(day" in plan(stored.where("day = DATE'2024-03-02'"))
    ops.store_user_sketches(e((1, "a", 1), (1, None, 7), (1, "b", None)), path)
    assert {(r.event_type, r.distinct_users) for r in ops.distinct_users(ops.stored_user_sketches(spark, path), "month").collect()} == {("a", 3), (None, 1), ("b", 0)}


# --- heavy hitters


def test_counters_keep_every_heavy_item():
    rng = random.Random(1)
    for size in (1, 2, 10):
        for _ in range(30):
            items = [rng.choice([0, 0, 1, rng.randrange(500)]) for _ in range(rng.randrange(1, 800))]
            c, at = Counters(size), 0
            while at < len(items):
                batch = Counter(items[at : at + 50])
                c.add(list(batch), list(batch.values()))
                at += 50
                assert len(c.count) <= size
            n = Counter(items)
            assert all(i in c.count for i, k in n.items() if k * (size + 1) > len(items))
            assert all(k <= n[i] for i, k in c.count.items())


@pytest.mark.parametrize("one_in", [1, 3, 40])
def test_heavy_hitters_are_exact(spark, one_in):
    rng = random.Random(one_in)
    items = [rng.choice([None, 7, 7, 7, rng.randrange(20), rng.randrange(5000)]) for _ in range(6000)]
    df = spark.createDataFrame([(i,) for i in items], "user_id long").repartition(9)
    n = Counter(i for i in items if i is not None)
    total = sum(n.values())
    want = {(i, k, k * 100.0 / total) for i, k in n.items() if k * one_in > total}
    assert set(map(tuple, ops.heavy_hitters(df, "user_id", one_in).collect())) == want
    assert heavy_candidates(df.where("user_id IS NOT NULL"), "user_id", one_in).count() <= 9 * one_in
    assert ops.heavy_hitters(df.limit(0), "user_id", one_in).collect() == []
    top = ops.top_users(df.withColumn("value", F.lit(1.0)), 1).first()
    assert one_in == 1 or max(want, key=lambda r: r[1])[:2] == (top.user_id, top.n_events)


def test_heavy_strings(spark):
    df = spark.createDataFrame([("é",), ("é",), ("b",), (None,)], "s string")
    assert rows(ops.heavy_hitters(df, "s", 2)) == [("é", 2, 200 / 3)]


# --- table changes


def test_table_changes(spark):
    nan = float("nan")
    old = [(1, "a", 1.5), (1, "a", 1.5), (2, None, None), (None, None, None), (3, "c", nan), (4, "gone", 0.0)]
    new = [(1, "a", 1.5), (2, None, None), (2, None, None), (None, None, None), (3, "c", nan), (5, "come", 0.0), (5, "come", 0.0)]
    a, b = (spark.createDataFrame(x, "k long, s string, v double").repartition(3) for x in (old, new))
    want = [(1, "a", 1.5, -1), (2, None, None, 1), (4, "gone", 0.0, -1), (5, "come", 0.0, 2)]
    assert rows(ops.table_changes(a, b.select("v", "s", "k"))) == sorted(want, key=str)
    assert rows(ops.rows_added(a, b)) == rows(b.exceptAll(a)) and rows(ops.rows_removed(a, b)) == rows(a.exceptAll(b))
    assert ops.table_changes(a, a).collect() == []
    assert len(rows(ops.table_changes(a.limit(0), b))) == 5
    p = plan(ops.table_changes(a, b))
    assert p.count("hashpartitioning(k#") == 1  # one shuffle of both versions
    with pytest.raises(ValueError, match="'s'"):
        ops.table_changes(a, b.drop("s"))


# --- funnels


def brute_funnel(events, steps, within):
    best = {}
    for user in {u for u, _, _ in events} - {None}:
        own = [(c, t) for u, c, t in events if u == user and t is not None]

        def reach(k, t0, t):
            if k == len(steps):
                return k
            later = [x for c, x in own if c == steps[k] and x > t and x - t0 <= within]
            return max([reach(k + 1, t0, x) for x in later], default=k)

        best[user] = max([reach(1, t, t) for c, t in own if c == steps[0]], default=0)
    return [(k, s, sum(b >= k for b in best.values())) for k, s in enumerate(steps, 1)]


@pytest.mark.parametrize("steps", [("a", "b", "c"), ("a", "a", "b"), ("a",)])
@pytest.mark.parametrize("within", [1, 6, 1000])
def test_funnel(spark, steps, within):
    """A very active actor, ties in time, null rows and repeated steps."""
    rng = random.Random(within)
    events = [(rng.choice([None, 7, 7, 7, *range(12)]), rng.choice("abcd"), None if rng.random() < 0.03 else rng.randrange(80)) for _ in range(160)]
    df = spark.createDataFrame([(u, c, None if t is None else T0 + dt.timedelta(microseconds=t)) for u, c, t in events], "user_id long, event_type string, ts timestamp_ntz")
    got = ops.ordered_funnel(df, steps, within)
    assert sorted((r.step, r.category, r.n_users) for r in got.collect()) == brute_funnel(events, steps, within)
    assert [r.n_users for r in ops.ordered_funnel(df.limit(0), steps, within).collect()] == [0] * len(steps)


def test_funnel_shuffles_events_once(spark):
    df = spark.createDataFrame([(1, "a", T0)], "user_id long, event_type string, ts timestamp_ntz")
    p = plan(ops.ordered_funnel(df, ("a", "b", "c"), 1000))
    assert p.count("hashpartitioning(user#") == 2  # by actor and group; then a row per actor and group
    assert "group#" in p.split("hashpartitioning(user#")[1][:60]


# --- bucketed tables


def test_bucketed_join_has_no_shuffle(spark, tmp_path):
    lines = spark.range(5000).selectExpr("id % 700 AS k", "id AS line")
    orders = spark.range(700).selectExpr("id AS k", "id * 2 AS v")
    a = write_bucketed(lines, "bucketed_lines", str(tmp_path / "a"), ["k"], 4)
    write_bucketed(orders, "bucketed_orders", str(tmp_path / "b"), ["k"], 4)
    spark.sql("DROP TABLE bucketed_orders")
    b = open_bucketed(spark, "bucketed_again", str(tmp_path / "b"), "k BIGINT, v BIGINT", ["k"], 4)
    try:
        joined = a.join(b.hint("merge"), "k")
        p = plan(joined)
        assert "SortMergeJoin" in p and "Exchange" not in p.replace("AQEShuffle", "")
        assert rows(joined) == rows(lines.join(orders, "k"))
    finally:
        spark.sql("DROP TABLE bucketed_lines")
        spark.sql("DROP TABLE bucketed_again")


def test_bucketed_nation_flows(spark):
    assert rows(QUERIES["bucketed_nation_flows"](spark, SF0001)) == rows(QUERIES["nation_flows"](spark, SF0001))


# --- incremental rollup


def test_rollup_reads_only_new_days(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(4)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

    def put(day, n):
        data = [(i, None if rng.random() < 0.1 else dt.datetime(2024, 3, day, rng.randrange(24)), 1, rng.choice(["a", "b", None]), rng.choice([None, 1.25, -2.0]), None) for i in range(n)]
        spark.createDataFrame(data, schema).withColumn("dt", F.lit(f"2024-03-{day:02}")).coalesce(1).write.mode("append").partitionBy("dt").parquet(source)

    def check():
        events = spark.read.schema(f"{schema}, dt string").parquet(source)
        want = events.groupBy(F.col("dt").cast("date").alias("day"), "event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n_events"), F.sum("value").alias("volume"))
        assert rows(ops.hourly_totals(ops.stored_rollup(spark, path))) == rows(want)
        assert rows(ops.period_totals(ops.stored_rollup(spark, path), "month")) == rows(want.groupBy(F.trunc("day", "month"), "event_type").agg(F.sum("n_events"), F.sum("volume")))

    assert ops.refresh_hourly_rollup(spark, source, path) == [] and ops.stored_rollup(spark, path) is None
    put(1, 50)
    put(2, 50)
    assert ops.refresh_hourly_rollup(spark, source, path) == ["2024-03-01", "2024-03-02"]
    check()
    assert ops.refresh_hourly_rollup(spark, source, path) == []
    put(3, 20)
    assert ops.refresh_hourly_rollup(spark, source, path) == ["2024-03-03"]
    put(1, 5)  # more rows of an old day
    assert ops.refresh_hourly_rollup(spark, source, path) == ["2024-03-01"]
    check()
    import shutil

    shutil.rmtree(f"{source}/dt=2024-03-02")  # a day is taken back
    assert ops.refresh_hourly_rollup(spark, source, path) == []
    check()
    stored = ops.stored_rollup(spark, path)
    assert {r.source_files for r in stored.where("day = DATE'2024-03-01'").collect()} == {2}

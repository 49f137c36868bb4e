"""As-of and range joins against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from flowtally.operators.asof import DAY, asof_join, last_before
from flowtally.operators.intervals import followups, interval_join, overlap_join
from tests.test_plans import plan

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_asof(left, right, forward=False, strict=False, tolerance=None):
    """left: (k, t, id), right: (k, t, id) -> (k, t, id, right t, right id)."""
    out = []
    for k, t, i in left:
        best = None
        for rk, rt, ri in right:
            if None in (k, t, rk, rt) or rk != k:
                continue
            gap = rt - t if forward else t - rt
            if gap < 0 or strict and gap == 0 or tolerance is not None and gap > tolerance:
                continue
            if best is None or (-gap, ri if ri is not None else -1) > best[0]:
                best = ((-gap, ri if ri is not None else -1), rt, ri)
        out.append((k, t, i, *(best[1:] if best else (None, None))))
    return sorted(out, key=str)


def tables(spark, rng, n, hot=0.4):
    def some(n):
        return [
            (None if rng.random() < 0.05 else 7 if rng.random() < hot else rng.randrange(6), None if rng.random() < 0.05 else rng.randrange(-40, 60), rng.randrange(1000))
            for _ in range(n)
        ]

    left, right = some(n), some(n)
    right += right[:5]  # repeated rows
    make = lambda x: spark.createDataFrame(x, "k long, t long, id long").repartition(3)
    return left, right, make(left), make(right)


@pytest.mark.parametrize("piece", [1, 10, 1000])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, piece, forward, strict):
    left, right, l, r = tables(spark, random.Random(piece), 150)
    args = {"on": ["k"], "left_time": "t", "ties": ["id"], "prefix": "r_", "direction": "forward" if forward else "backward", "strict": strict, "piece": piece}
    assert rows(asof_join(l, r, **args)) == brute_asof(left, right, forward, strict)
    want = brute_asof(left, right, forward, strict, 4)
    assert rows(asof_join(l, r, tolerance=4, **args)) == want
    assert rows(asof_join(l, r, tolerance=4, how="inner", **args)) == [x for x in want if x[3] is not None]


def test_asof_empty_and_names(spark):
    _, _, l, r = tables(spark, random.Random(0), 20)
    none = l.limit(0)
    assert {x[3:] for x in rows(asof_join(l, none, ["k"], "t", prefix="r_"))} == {(None, None)}
    assert rows(asof_join(none, r, ["k"], "t", prefix="r_")) == []
    with pytest.raises(ValueError, match="id"):
        asof_join(l, r, ["k"], "t")
    # names that the operator uses itself, two keys, and other time columns
    odd = spark.createDataFrame([(1, 2, 5, "a", 0)], "k0 long, k1 long, at long, row string, side int")
    other = spark.createDataFrame([(1, 2, 4, "b"), (1, 3, 5, "c")], "k0 long, k1 long, piece long, found string")
    assert rows(asof_join(odd, other, ["k0", "k1"], "at", "piece")) == [(1, 2, 5, "a", 0, 4, "b")]


def test_asof_hot_key_is_cut_into_pieces(spark):
    """The windows are per key and piece; what meets per key is a row a piece."""
    events = spark.createDataFrame([(1, T0, 1)], "user_id long, ts timestamp_ntz, event_id long")
    p = plan(asof_join(events, events, ["user_id"], "ts", prefix="last_", piece=DAY))
    assert "NestedLoop" not in p and "Cartesian" not in p and "EvalPython" not in p
    assert "hashpartitioning(k0" in p and "piece" in p.split("hashpartitioning(k0")[1][:40]


def test_last_before(spark):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    data = [(1, "view", 1, s(0)), (2, "view", 1, s(5)), (3, "view", 1, s(5)), (4, "buy", 1, s(5)), (5, "buy", 2, s(9)), (6, "buy", None, s(9)), (7, "buy", 1, None), (8, "buy", 1, s(86400 * 40))]
    events = spark.createDataFrame(data, "event_id long, event_type string, user_id long, ts timestamp_ntz")
    got = {r.event_id: (r.last_event_id, r.seconds_since) for r in last_before(events, "buy", "view").collect()}
    assert got == {4: (3, 0.0), 5: (None, None), 6: (None, None), 7: (None, None), 8: (3, 86400 * 40 - 5.0)}


def brute_inside(points, spans, keyed=True):
    return sorted(
        ((*p, *(s[1:] if keyed else s)) for p in points for s in spans if None not in (p[1], s[1], s[2]) and s[1] <= p[1] < s[2] and (not keyed or p[0] is not None and p[0] == s[0])),
        key=str,
    )


@pytest.mark.parametrize("width", [1, 7, 5000])
def test_interval_join(spark, width):
    """Short and long intervals, borders on bin borders, negative times,
    empty and reversed intervals, nulls, repeated rows and a crowded bin."""
    rng = random.Random(width)
    key = lambda: rng.choice([None, 1, 1, 1, 2, 3])
    points = [(key(), None if rng.random() < 0.05 else rng.choice([rng.randrange(-300, 300), 5]), i) for i in range(200)]
    spans = []
    for i in range(60):
        low = rng.randrange(-300, 300) // 7 * 7
        spans.append((key(), None if i == 3 else low, None if i == 4 else low + rng.choice([-5, 0, 1, 7, 30, 900]), i))
    points, spans = points + points[:5], spans + spans[:5]
    p = spark.createDataFrame(points, "k long, at long, p long").repartition(3)
    s = spark.createDataFrame(spans, "k long, low long, high long, s long").repartition(2)
    want = brute_inside(points, spans)
    assert rows(interval_join(p, s, "at", "low", "high", ["k"], width=width)) == want
    matched = {w[:3] for w in want}
    alone = [x for x in points if x not in matched]
    assert rows(interval_join(p, s, "at", "low", "high", ["k"], "anti", width=width)) == sorted(alone, key=str)
    both = sorted([*want, *((*x, None, None, None) for x in alone)], key=str)
    assert rows(interval_join(p, s, "at", "low", "high", ["k"], "left", width=width)) == both
    free = s.withColumnRenamed("k", "k2")
    assert rows(interval_join(p, free, "at", "low", "high", width=width)) == brute_inside(points, spans, keyed=False)
    assert interval_join(p, s.limit(0), "at", "low", "high", ["k"]).collect() == []
    assert interval_join(p, s.limit(0), "at", "low", "high", ["k"], "left").count() == len(points)
    assert interval_join(p.limit(0), s, "at", "low", "high", ["k"]).collect() == []


def test_overlap_join(spark):
    rng = random.Random(6)
    span = lambda i: (rng.choice([None, 1, 2]), a := rng.randrange(100), a + rng.choice([-1, 0, 1, 5, 60]), i)
    a, b = [span(i) for i in range(80)], [span(i) for i in range(80)]
    left = spark.createDataFrame(a, "k long, a0 long, a1 long, i long")
    right = spark.createDataFrame(b, "k long, b0 long, b1 long, j long")
    want = [(*x, *y[1:]) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and max(x[1], y[1]) < min(x[2], y[2])]
    assert rows(overlap_join(left, right, ("a0", "a1"), ("b0", "b1"), ["k"], width=3)) == sorted(want, key=str)


def test_interval_join_plan(spark):
    """No nested loop, and a crowded bin is split when the sides are sorted
    and merged."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        points = spark.range(40_000).selectExpr("if(id % 3 = 0, id, 500 + id % 7) AS at", "id AS p").repartition(8)
        spans = spark.range(50).selectExpr("id * 800 AS low", "id * 800 + 700 AS high", "id AS s")
        out = interval_join(points, spans, "at", "low", "high", width=800)
        assert out.count() == sum(1 for i in range(40_000) if (i if i % 3 == 0 else 500 + i % 7) % 800 < 700)
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final and "NestedLoop" not in final and "Cartesian" not in final
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_followups(spark):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    data = [(1, "error", 1, s(0)), (2, "click", 1, s(0)), (3, "click", 1, s(59)), (4, "click", 1, s(60)), (5, "click", 2, s(1)), (6, "error", 1, s(30)), (7, "click", None, s(1)), (8, "error", None, s(0))]
    events = spark.createDataFrame(data, "event_id long, event_type string, user_id long, ts timestamp_ntz")
    got = {(r.cause_id, r.event_id, r.seconds_after) for r in followups(events, "error", 60_000_000).collect()}
    assert got == {(1, 2, 0.0), (1, 3, 59.0), (1, 6, 30.0), (6, 3, 29.0), (6, 4, 30.0)}

"""Exact quantiles against a brute-force exact computation, with values of many
magnitudes, negatives, duplicates, a group holding most rows, tiny groups and a
null group."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from flowtally.operators import exact_quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.999, 1.0)


def _expected(values_by_group):
    out = {}
    for g, vals in values_by_group.items():
        cents = sorted(int(round(v * 100)) for v in vals)
        n = len(cents)
        row = {"n_values": n}
        for p in PROBS:
            h = (n - 1) * Decimal(str(p))
            lo = int(h // 1)
            hi = lo if h == lo else lo + 1
            v_lo, v_hi = Decimal(cents[lo]) / 100, Decimal(cents[hi]) / 100
            row[p] = float(v_lo + (v_hi - v_lo) * (h - lo))
        out[g] = row
    return out


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(7)
    rows = []
    # hot group: most rows, magnitudes from a cent to 1e12 (the largest that a
    # DOUBLE still holds to the cent), both signs: the two low 21-bit digits
    # of the key take many values, the top one splits on sign and magnitude
    for _ in range(6000):
        mag = 10 ** rnd.uniform(-2, 12)
        v = round(mag * rnd.choice((1, 1, 1, -1)), 2)
        rows.append(("hot", v))
    rows += [("hot", 123.45)] * 500  # one value repeated
    rows += [("one", 7.0)]
    rows += [("two", -1.5), ("two", 2.25)]
    rows += [("same", 3.3)] * 5
    rows += [(None, 1.0), (None, 2.0), (None, 4.0)]
    rows += [("one", None), (None, None)]  # null values are ignored
    return rows


def test_exact_quantiles_brute_force(spark, data):
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(df, "g", "v", PROBS).collect()}
    by_group = {}
    for g, v in data:
        if v is not None:
            by_group.setdefault(g, []).append(v)
    want = _expected(by_group)
    assert set(got) == set(want)
    from flowtally.operators.quantiles import _prob_label

    for g, row in want.items():
        assert got[g]["n_values"] == row["n_values"], g
        for p in PROBS:
            assert got[g][_prob_label(p)] == row[p], (g, p)


def test_labels():
    from flowtally.operators.quantiles import _prob_label

    assert [_prob_label(p) for p in (0.5, 0.95, 0.999, 1.0, 0.0, 1, 0, 0.01, 0.1)] == [
        "p50", "p95", "p99_9", "p100", "p0", "p100", "p0", "p1", "p10"]


def test_rejects_bad_probability(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    with pytest.raises(ValueError):
        exact_quantiles(df, "g", "v", (1.5,))
    with pytest.raises(ValueError):
        exact_quantiles(df, "g", "v", (0.5, 0.50))


def test_global_quantiles(spark, data):
    df = spark.createDataFrame(data, "g string, v double")
    rows = exact_quantiles(df, None, "v", PROBS).collect()
    assert len(rows) == 1 and "g" not in rows[0].asDict()
    want = _expected({"all": [v for _, v in data if v is not None]})["all"]
    from flowtally.operators.quantiles import _prob_label

    assert rows[0]["n_values"] == want["n_values"]
    for p in PROBS:
        assert rows[0][_prob_label(p)] == want[p], p


def test_values_are_not_rounded_and_non_finite_ones_ignored(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0.001), ("a", 0.004), ("a", 0.0049), ("a", nan), ("a", inf), ("a", -inf), ("a", None), ("b", nan)]
    rows += [("c", 1e-9), ("c", 3e-9), ("d", 1e300), ("d", -1e300), ("d", 5.0)]
    got = {r.g: (r.n_values, r.p50) for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", (0.5,)).collect()}
    assert got == {"a": (3, 0.004), "c": (2, 1e-9 + (3e-9 - 1e-9) * 0.5), "d": (3, 5.0)}


def test_rejects_too_many_decimals(spark):
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame([("a", 1.0)], "g string, v double"), "g", "v", (0.123456789,))


def test_empty_table(spark):
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", (0.5,)).collect() == []


def test_hot_group_lies_in_many_pieces(spark):
    """No task holds a group: with one hot group of close values, each piece
    holds a small share, pieces follow the order of the values, and only pieces
    with a wanted rank reach the window (broadcasts off)."""
    from flowtally.operators.quantiles import _sorted_pieces

    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in zip(keys, ("false", "-1", "-1")):
            spark.conf.set(k, v)
        df = spark.range(40_000).selectExpr("if(id % 10 = 0, 'cold', 'hot') AS g", "100 + id / 1000 AS v")
        pieces = _sorted_pieces(df, "g", "v").groupBy("g.k", "piece").agg({"v": "min", "*": "count"}).collect()
        hot = sorted((r.piece, r["min(v)"], r["count(1)"]) for r in pieces if r.k == "hot")
        assert len(hot) >= 6 and max(n for *_, n in hot) < 36_000 / 3
        assert [v for _, v, _ in hot] == sorted(v for _, v, _ in hot)
        q = df.groupBy("g").agg(*[F.percentile("v", p).alias(f"q{i}") for i, p in enumerate((0.1, 0.5, 0.95))])
        want = {r.g: (r.q0, r.q1, r.q2) for r in q.collect()}
        got = {r.g: (r.p10, r.p50, r.p95) for r in exact_quantiles(df, "g", "v", (0.1, 0.5, 0.95)).collect()}
        assert {g: pytest.approx(v, rel=1e-12) for g, v in want.items()} == got
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

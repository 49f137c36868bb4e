"""Sessions, in batch and as a stream, and the stream-stream join."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from flowtally.operators.sessions import user_sessions
from flowtally.streaming.attribution import HOUR, run_attribution
from flowtally.streaming.sessions import closed_sessions, run_sessions
from flowtally.streaming.source import LateRowsWarning
from tests.fixtures import write_events

T0 = dt.datetime(2024, 3, 1)
GAP = 30 * 60 * 1_000_000


def make(rng, n, users=4, days=3, first_id=0):
    """Events with times on the gap, repeated times, nulls and a hot actor."""
    rows = []
    for i in range(n):
        t = T0 + dt.timedelta(minutes=15 * rng.randrange(days * 96), microseconds=rng.choice([0, 0, 1, 999_999]))
        rows.append((first_id + i, None if rng.random() < 0.04 else t, None if rng.random() < 0.04 else rng.choice([7, 7, rng.randrange(users)]), rng.choice(["click", "purchase", "view"]), rng.choice([None, 1.25, -3.0, 0.1]), None))
    return rows


def brute(rows, gap=GAP):
    out = []
    for user in {r[2] for r in rows} - {None}:
        own = sorted((r for r in rows if r[2] == user and r[1] is not None), key=lambda r: r[1])
        held = []
        for r in own:
            if held and (r[1] - held[-1][-1][1]) / dt.timedelta(microseconds=1) <= gap:
                held[-1].append(r)
            else:
                held.append([r])
        for s in held:
            cents = [round(r[4] * 100) for r in s if r[4] is not None]
            out.append((user, s[0][1], s[-1][1], len(s), sum(cents) / 100 if cents else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("piece", [3_600_000_000, 86_400_000_000, 10**15])
def test_batch(spark, tmp_path, piece):
    rows = make(random.Random(piece), 400)
    write_events(str(tmp_path / "e.parquet"), rows)
    events = spark.read.parquet(str(tmp_path / "e.parquet"))
    assert got(user_sessions(events, piece=piece)) == brute(rows)
    assert got(user_sessions(events, gap=0, piece=piece)) == brute(rows, 0)
    assert user_sessions(events.limit(0)).collect() == []


def put(folder, name, rows, at):
    os.makedirs(folder, exist_ok=True)
    write_events(f"{folder}/{name}", rows)
    os.utime(f"{folder}/{name}", (at, at))


def test_stream_equals_batch(spark, tmp_path):
    """In one batch and in one batch per file, with a restart between, in
    order of time; repeated ids count once."""
    rng = random.Random(2)
    rows = sorted((r for r in make(rng, 300, days=6) if r[1] is not None), key=lambda r: r[1])
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    for k in range(3):
        again = rows[75 * k - 1 : 75 * k] if k else []  # repeated in the next file
        put(src, f"{k}.parquet", again + rows[75 * k : 75 * (k + 1)], 1_700_000_000 + k)
    first = run_sessions(spark, src, max_files_per_trigger=1, out_dir=out, checkpoint_dir=ckpt)
    assert got(first) == brute(rows[:225])
    assert {r.closed for r in first.collect()} == {True, False}
    assert got(closed_sessions(spark, out)) == got(first.where("closed"))
    put(src, "3.parquet", rows[225:], 1_700_000_010)
    again = run_sessions(spark, src, checkpoint_dir=ckpt)
    assert got(again) == brute(rows)
    # closed sessions stay as they were
    assert set(got(first.where("closed"))) <= set(got(again.where("closed")))
    # a new checkpoint reads everything into a new run
    assert got(run_sessions(spark, src, out_dir=out)) == brute(rows)
    with pytest.raises(ValueError, match="newer query"):
        run_sessions(spark, src, checkpoint_dir=ckpt)


def test_late_rows_are_counted(spark, tmp_path):
    src = str(tmp_path / "in")
    days = [1, 2, 9, 10, 1]
    for k, day in enumerate(days):
        put(src, f"{k}.parquet", [(k, T0 + dt.timedelta(days=day, hours=3 * (k == 4)), 1, "click", 1.0, None)], 1_700_000_000 + k)
    with pytest.warns(LateRowsWarning, match="^1 rows"):
        assert len(got(run_sessions(spark, src, max_files_per_trigger=1))) == 4


def test_stream_without_rows(spark, tmp_path):
    put(str(tmp_path / "in"), "0.parquet", [(1, None, 1, "click", 1.0, None)], 1_700_000_000)
    assert run_sessions(spark, str(tmp_path / "in")).collect() == []
    assert run_attribution(spark, str(tmp_path / "in"), "click", "purchase").collect() == []


def pairs(rows, within=HOUR):
    seen = {r[0]: r for r in rows if None not in r[:3]}.values()
    micro = dt.timedelta(microseconds=1)
    return sorted((c[2], c[0], e[0], c[1], e[1]) for c in seen for e in seen if (c[3], e[3], c[2]) == ("click", "purchase", e[2]) and 0 <= (e[1] - c[1]) / micro < within)


def test_attribution_equals_batch(spark, tmp_path):
    """Restarted after each file; pairs over file borders are found, repeated
    ids pair once, borders of the range and of the bins count once."""
    rng = random.Random(3)
    rows = sorted((r for r in make(rng, 240, days=2) if r[1] is not None), key=lambda r: r[1])
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    for k in range(3):
        put(src, f"{k}.parquet", rows[max(0, 80 * k - 2) : 80 * (k + 1)], 1_700_000_000 + k)
        found = run_attribution(spark, src, "click", "purchase", out_dir=out, checkpoint_dir=ckpt)
        assert sorted(map(tuple, found.collect())) == pairs(rows[: 80 * (k + 1)])
    assert len(pairs(rows)) > 40
    once = run_attribution(spark, src, "click", "purchase", within=HOUR // 3, max_files_per_trigger=1)
    assert sorted(map(tuple, once.collect())) == pairs(rows, HOUR // 3)

"""Streaming daily counts: micro-batches, late rows, repeated ids, resume."""

from __future__ import annotations

import os
import tempfile
import warnings

import pytest
from pyspark.sql import functions as F

from flowtally.functions import exact_sum
from flowtally.session import unique_dir
from flowtally.streaming import run_daily_counts
from flowtally.streaming.daily_counts import LateRowsWarning, current_table
from tests.fixtures import T, write_events


def _write(folder, name, rows, mtime):
    path = os.path.join(folder, name)
    write_events(path, rows)
    os.utime(path, (mtime, mtime))


def _result(df):
    return {(str(r["day"]), r["event_type"]): (r["n_events"], r["volume"]) for r in df.collect()}


def test_late_rows_and_duplicates(spark):
    src = tempfile.mkdtemp(prefix="flowtally-stream-src-")
    base = 1_700_000_000
    _write(src, "a.parquet", [
        (1, T("2024-03-01 10:00:00"), 1, "click", 1.00, None),
        (2, T("2024-03-01 11:00:00"), 2, "click", 2.00, None),
        (3, T("2024-03-02 11:00:00"), 1, "purchase", 10.00, None),
    ], base)
    # watermark after batch 1: 2024-03-02 11:00 - 1 day = 2024-03-01 11:00
    _write(src, "b.parquet", [
        (3, T("2024-03-02 11:00:00"), 1, "purchase", 10.00, None),  # repeated id, inside watermark
        (4, T("2024-03-05 10:00:00"), 3, "purchase", 5.00, None),
        (5, T("2024-03-02 12:00:00"), 3, "click", 4.00, None),  # older than max, inside watermark
    ], base + 10)
    # watermark after batch 2: 2024-03-04 10:00
    _write(src, "c.parquet", [
        (7, T("2024-03-05 11:00:00"), 4, "purchase", 0.50, None),  # updates day 5 again
    ], base + 20)
    # Spark judges lateness against the watermark of the previous batch, so
    # from batch 4 on a row whose day ended before 2024-03-04 10:00 is late
    _write(src, "d.parquet", [
        (6, T("2024-03-02 08:00:00"), 4, "click", 100.00, None),  # late: dropped
    ], base + 30)

    out, ckpt = unique_dir(spark, "test-out"), unique_dir(spark, "test-ckpt")
    got = _result(run_daily_counts(spark, src, max_files_per_trigger=1, out_dir=out, checkpoint_dir=ckpt))
    assert got == {
        ("2024-03-01", "click"): (2, 3.0),
        ("2024-03-02", "purchase"): (1, 10.0),
        ("2024-03-02", "click"): (1, 4.0),
        ("2024-03-05", "purchase"): (2, 5.5),
    }

    # The table has one row per (day, category); it is stored by day.
    stored = current_table(spark, out)
    assert stored.count() == stored.select("day", "event_type").distinct().count() == 4
    assert sorted(p for p in os.listdir(out) if p.startswith("day=")) == [
        "day=2024-03-01", "day=2024-03-02", "day=2024-03-05"]

    # A new file is picked up by a second run on the same checkpoint; the
    # files already processed are not read again.
    _write(src, "e.parquet", [(8, T("2024-03-05 12:00:00"), 5, "purchase", 1.00, None)], base + 40)
    got = _result(run_daily_counts(spark, src, max_files_per_trigger=1, out_dir=out, checkpoint_dir=ckpt))
    assert got[("2024-03-05", "purchase")] == (3, 6.5)
    assert got[("2024-03-01", "click")] == (2, 3.0)


def test_single_file_source_matches_batch(spark, fixture_dir):
    path = os.path.join(fixture_dir, "events.parquet")
    got = _result(run_daily_counts(spark, path))
    batch = (
        spark.read.parquet(path).where("ts IS NOT NULL")
        .groupBy(F.to_date("ts").alias("day"), "event_type")
        .agg(F.count("*").alias("n_events"), exact_sum("value").alias("volume"))
    )
    assert got == _result(batch)
    assert got[("2024-01-05", "purchase")] == (12, 60.0)
    assert ("2024-02-01", "purchase") in got and ("2024-01-31", "purchase") in got


def test_state_partitions_leave_session_unchanged(spark, fixture_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = run_daily_counts(spark, os.path.join(fixture_dir, "events.parquet"), state_partitions=3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert df.count() > 0


def test_merge_sink_is_idempotent(spark):
    """A retried micro-batch rewrites the same rows; a replayed older batch
    does not override newer rows."""
    import datetime as dt

    from flowtally.streaming.daily_counts import _merge_writer, current_table

    out = unique_dir(spark, "test-merge")
    write = _merge_writer(out)
    schema = "day date, event_type string, n_events bigint, volume double"
    d1, d2 = dt.date(2024, 3, 1), dt.date(2024, 3, 2)
    b1 = spark.createDataFrame([(d1, "click", 2, 3.0), (d2, "view", 1, 1.0)], schema)
    b2 = spark.createDataFrame([(d2, "view", 4, 9.5)], schema)

    def table():
        return sorted((str(r.day), r.event_type, r.n_events, r.volume) for r in current_table(spark, out).collect())

    write(b1, 1)
    write(b1, 1)  # retried
    assert table() == [("2024-03-01", "click", 2, 3.0), ("2024-03-02", "view", 1, 1.0)]
    write(b2, 2)
    write(b1, 1)  # an old batch replayed after a newer one
    assert table() == [("2024-03-01", "click", 2, 3.0), ("2024-03-02", "view", 4, 9.5)]
    write(spark.createDataFrame([], schema), 3)  # empty batch: nothing changes
    assert len(table()) == 2


def test_rocksdb_state_store(spark, fixture_dir):
    """The cluster settings put stream state in RocksDB; results are the same."""
    from flowtally.session import CLUSTER_CONF

    keys = [k for k in CLUSTER_CONF if k.startswith("spark.sql.streaming.stateStore")]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, CLUSTER_CONF[k])
        got = _result(run_daily_counts(spark, os.path.join(fixture_dir, "events.parquet"), state_partitions=2))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got[("2024-01-05", "purchase")] == (12, 60.0)


def test_rows_without_id_all_count(spark, tmp_path):
    from flowtally.streaming import daily_counts

    rows = [(None, 1.0), (None, 1.0), (None, 1.0), (5, 1.0), (5, 1.0)]
    events = spark.createDataFrame(rows, "event_id long, value double").selectExpr(
        "event_id", "TIMESTAMP_NTZ '2024-03-20 01:00:00' AS ts", "1L AS user_id", "'a' AS event_type", "value", "'{}' AS props"
    )
    events.write.parquet(str(tmp_path / "in"))
    got = daily_counts.run_daily_counts(spark, str(tmp_path / "in")).collect()
    assert [(r.n_events, r.volume) for r in got] == [(4, 4.0)]


def test_merge_reads_only_the_touched_days(spark, tmp_path):
    from flowtally.streaming import daily_counts

    out = str(tmp_path / "out")
    first = spark.sql("SELECT * FROM VALUES (DATE'2024-01-01', 'a', 1L, 1.0D), (DATE'2024-01-02', 'b', 1L, 1.0D) t(day, event_type, n_events, volume)")
    daily_counts._merge(first, 0, out)
    daily_counts._merge(first.where("event_type = 'a'").withColumn("n_events", first.n_events + 4), 1, out)
    assert sorted((str(r.day), r.n_events) for r in daily_counts.current_table(spark, out).collect()) == [("2024-01-01", 5), ("2024-01-02", 1)]
    pruned = spark.read.parquet(out).where("day IN (DATE'2024-01-01')")._jdf.queryExecution().executedPlan().toString()
    assert "2024" in pruned.split("PartitionFilters")[1].split("PushedFilters")[0] or "19723" in pruned


def test_other_read_errors_are_raised(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    from flowtally.streaming import daily_counts

    class Reader:
        def schema(self, schema):
            return self

        def parquet(self, path):
            return spark.sql("SELECT no_such_column")

    class Session:
        read = Reader()

    assert daily_counts._read_result(spark, str(tmp_path / "missing")) is None
    with pytest.raises(AnalysisException):
        daily_counts._read_result(Session(), "x")


def test_late_rows_are_reported(spark):
    """Files out of time order: one batch counts every row, one file per batch
    drops the late ones and says how many; in time order none is dropped."""

    def run(days, per_trigger):
        src = tempfile.mkdtemp(prefix="flowtally-stream-src-")
        for i, day in enumerate(days):
            _write(src, f"{i}.parquet", [(i, T(f"2024-03-{day} 10:00:00"), 1, "click", 1.00, None)], 1_700_000_000 + 10 * i)
        return _result(run_daily_counts(spark, src, max_files_per_trigger=per_trigger))

    out_of_order = ("20", "21", "05", "06")
    with warnings.catch_warnings():
        warnings.simplefilter("error", LateRowsWarning)
        assert len(run(out_of_order, None)) == 4
        assert len(run(sorted(out_of_order), 1)) == 4
    with pytest.warns(LateRowsWarning, match="^2 rows"):
        assert len(run(out_of_order, 1)) == 2


def test_crashed_merge_is_written_again(spark, tmp_path, monkeypatch):
    """A batch that dies after publishing some of its days, or before it is
    committed, leaves readers whole days; its retry gives the same table.  Two
    versions of a day are kept at most."""
    import datetime as dt
    import shutil

    from flowtally.streaming import daily_counts

    out = str(tmp_path / "out")
    schema = "day date, event_type string, n_events bigint, volume double"
    d1, d2 = dt.date(2024, 3, 1), dt.date(2024, 3, 2)
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    table = lambda: sorted((str(r.day), r.event_type, r.n_events) for r in current_table(spark, out).collect())
    versions = lambda day: sorted(os.listdir(f"{out}/day={day}"))
    daily_counts._merge(frame((d1, "a", 1, 1.0), (d1, "b", 1, 1.0), (d2, "a", 1, 1.0)), 0, out)
    update = frame((d1, "a", 5, 5.0), (d2, "c", 7, 7.0))
    with monkeypatch.context() as m:  # dies after the write, before the stream's commit
        m.setattr(daily_counts, "_drop_old_versions", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            daily_counts._merge(update, 1, out)
    shutil.move(f"{out}/day={d2}/batch_id=1", str(tmp_path / "unpublished"))  # ... or with one day published
    assert table() == [("2024-03-01", "a", 5), ("2024-03-01", "b", 1), ("2024-03-02", "a", 1)]
    want = [("2024-03-01", "a", 5), ("2024-03-01", "b", 1), ("2024-03-02", "a", 1), ("2024-03-02", "c", 7)]
    for _ in range(2):
        daily_counts._merge(update, 1, out)
        assert table() == want
    daily_counts._merge(frame((d1, "b", 2, 2.0)), 2, out)
    assert versions(d1) == ["batch_id=1", "batch_id=2"] and versions(d2) == ["batch_id=0", "batch_id=1"]
    assert table() == [want[0], ("2024-03-01", "b", 2), *want[2:]]


def test_new_checkpoint_starts_a_new_run(spark, tmp_path):
    """A query with a new checkpoint reads everything again; its result
    replaces the folder's, also where it has fewer batches and days."""
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    os.makedirs(src)
    rows = lambda ids, day: [(i, T(f"2024-03-{day} 10:00:00"), 1, "click", 1.00, None) for i in ids]
    for k in range(3):
        _write(src, f"{k}.parquet", rows(range(2 * k, 2 * k + 2), "01"), 1_700_000_000 + k)
    run = lambda **a: _result(run_daily_counts(spark, src, out_dir=out, **a))
    assert run(max_files_per_trigger=1) == {("2024-03-01", "click"): (6, 6.0)}
    _write(src, "3.parquet", rows(range(10, 15), "01"), 1_700_000_010)
    assert run() == {("2024-03-01", "click"): (11, 11.0)}
    # ... and goes on with its own checkpoint, which knows the folder
    assert run(checkpoint_dir=ckpt) == {("2024-03-01", "click"): (11, 11.0)}
    _write(src, "4.parquet", rows([20], "02"), 1_700_000_020)
    assert _result(run_daily_counts(spark, src, checkpoint_dir=ckpt)) == {("2024-03-01", "click"): (11, 11.0), ("2024-03-02", "click"): (1, 1.0)}
    # a source without the first days: they are gone from the result, and from the disk
    other = str(tmp_path / "other")
    os.makedirs(other)
    _write(other, "0.parquet", rows([1], "02"), 1_700_000_000)
    assert _result(run_daily_counts(spark, other, out_dir=out)) == {("2024-03-02", "click"): (1, 1.0)}
    assert os.listdir(f"{out}/day=2024-03-01") == []
    # the older query may not go on, nor write elsewhere
    with pytest.raises(ValueError, match="newer query"):
        run(checkpoint_dir=ckpt)
    with pytest.raises(ValueError, match="belongs to"):
        run_daily_counts(spark, src, out_dir=str(tmp_path / "elsewhere"), checkpoint_dir=ckpt)


def test_unfinished_run_is_not_shown(spark, tmp_path, monkeypatch):
    from flowtally.streaming import daily_counts

    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    os.makedirs(src)
    _write(src, "0.parquet", [(1, T("2024-03-01 10:00:00"), 1, "click", 1.00, None)], 1_700_000_000)
    first = _result(run_daily_counts(spark, src, out_dir=out))
    _write(src, "1.parquet", [(2, T("2024-03-01 10:00:00"), 1, "click", 1.00, None)], 1_700_000_001)
    with monkeypatch.context() as m:  # dies after its batches, before it is finished
        m.setattr(daily_counts, "finish_run", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run_daily_counts(spark, src, out_dir=out, checkpoint_dir=ckpt)
    assert _result(current_table(spark, out)) == first
    assert _result(run_daily_counts(spark, src, checkpoint_dir=ckpt)) == {("2024-03-01", "click"): (2, 2.0)}


def test_bounded_batches(spark, tmp_path):
    """By default a micro-batch is bounded in bytes; the result is the same."""
    src = str(tmp_path / "in")
    os.makedirs(src)
    for k in range(4):
        _write(src, f"{k}.parquet", [(k, T("2024-03-01 10:00:00"), 1, "click", 1.00, None)], 1_700_000_000 + k)
    assert _result(run_daily_counts(spark, src, max_bytes_per_trigger=1)) == {("2024-03-01", "click"): (4, 4.0)}

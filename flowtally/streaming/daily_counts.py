"""Daily events and volume per category, computed as a stream.

New Parquet files in the source folder are read incrementally; each
micro-batch updates the per-(day, category) state.

* ``ts`` is TIMESTAMP_NTZ; the watermark needs TIMESTAMP, so ``event_time``
  is ``ts`` read as UTC (the session zone must be UTC, which is checked).
* The watermark is the latest event time seen so far minus ``watermark``.
  A row is late, and dropped, when it is older than the watermark that was in
  force in the previous micro-batch (Spark's rule for late rows with stateful
  operators; a row without an id only when its whole day is).  So the order of
  the files matters for late ones: a run that drops any warns with their
  number.  Days that can no longer change leave the state store, so state
  stays bounded.
* A repeated ``event_id`` inside the watermark is counted once
  (``dropDuplicatesWithinWatermark``).
* Output mode is update: every micro-batch emits the (day, category) rows it
  changed.  ``foreachBatch`` merges them into the result folder, which holds
  versions of whole days (``day=.../batch_id=...``): for the days a batch
  touched, the rows of their newest version before this batch are read
  (partition pruning keeps the read to those days), the batch's rows replace
  those of the same category, and the result is written as this batch's version
  of the day.  Nothing that is read is ever overwritten, so a batch that dies
  half-way is simply written again from the same older versions; readers take
  the newest version of each day.  The version before is kept (a retry starts
  from it), older ones are deleted, so the folder does not grow with the
  number of batches.  A query with a new checkpoint starts a new run of the
  folder (``runs``): its versions rank above all earlier ones, are merged only
  with each other, and are shown once it has finished.
  Progress and state live in the stream's checkpoint folder, so a restarted
  query (after a lost driver or executors) resumes where it stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtally.functions import cents, from_cents
from flowtally.sources.tables import TABLE_SCHEMAS
from flowtally.streaming.runs import current_run, delete, finish_run, forget_runs, list_names, open_run
from flowtally.streaming.source import BATCH_BYTES, LateRowsWarning, check_zone, file_stream, run_to_end, timed_once

__all__ = ["LateRowsWarning", "current_table", "daily_counts_stream", "run_daily_counts"]

RUN_BITS = 32  # a version's number is its run, then its batch in the run


def daily_counts_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The streaming aggregation (update-mode compatible).  Rows that repeat an
    ``event_id`` within the watermark count once; rows without an id are all
    counted.  Rows without ``ts`` belong to no day and are left out."""
    return (
        timed_once(stream, watermark)
        .groupBy(F.window("event_time", "1 day").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum(cents("value")).alias("_vol"))
        .select(
            F.col("w.start").cast("date").alias("day"),
            "event_type",
            "n_events",
            from_cents("_vol").alias("volume"),
        )
    )


_RESULT_SCHEMA = "event_type string, n_events bigint, volume double, day date, batch_id bigint"


def _read_result(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """All stored versions."""
    try:
        return spark.read.schema(_RESULT_SCHEMA).parquet(out_dir)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None  # no micro-batch has written yet
        raise


def _newest(versions: DataFrame) -> DataFrame:
    """Rows of each day's newest version (two versions of a day are kept, so a
    window holds a few rows per category)."""
    last = F.max("batch_id").over(Window.partitionBy("day"))
    return versions.withColumn("_last", last).where("batch_id = _last").drop("_last")


def _merge_writer(out_dir: str, run: int = 0):
    def write(batch: DataFrame, batch_id: int) -> None:
        # The micro-batch is computed once (the stateful operators run once),
        # then reused by the emptiness check and the merge.
        batch.persist()
        try:
            if batch.isEmpty():  # e.g. a batch that only advanced the watermark
                return
            _merge(batch, run << RUN_BITS | batch_id, out_dir)
        finally:
            batch.unpersist()

    return write


def _merge(batch: DataFrame, batch_id: int, out_dir: str) -> None:
    spark = batch.sparkSession
    updates = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
    # the touched days as literals (one per day of the batch) prune the read
    touched = [r.day for r in batch.select("day").distinct().collect()]
    existing = _read_result(spark, out_dir)
    if existing is not None:
        first = batch_id >> RUN_BITS << RUN_BITS  # of this run
        prior = _newest(existing.where(F.col("day").isin(touched) & F.col("batch_id").between(first, batch_id - 1)))
        updates = prior.select(*updates.columns).unionByName(updates)
    newest = F.max_by(F.struct("n_events", "volume"), "batch_id")
    (
        # one task per day: the aggregation below keeps this partitioning
        # and each version of a day is written as one file
        updates.repartition("day")
        .groupBy("day", "event_type")
        .agg(newest.alias("r"))
        .select("day", "event_type", "r.n_events", "r.volume", F.lit(batch_id).cast("long").alias("batch_id"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "batch_id")
        .parquet(out_dir)
    )
    _drop_old_versions(spark, [f"{out_dir}/day={day}" for day in touched], batch_id)


def _versions(spark: SparkSession, day: str) -> list[int]:
    """Numbers of the versions in a day's folder, ascending."""
    return sorted(int(n.split("=")[1]) for n in list_names(spark, day) if n.startswith("batch_id="))


def _drop_old_versions(spark: SparkSession, days: list[str], batch_id: int) -> None:
    """Of each day folder, deletes this run's versions older than the one
    before ``batch_id``."""
    for day in days:
        older = [n for n in _versions(spark, day) if n < batch_id and n >> RUN_BITS == batch_id >> RUN_BITS]
        for n in older[:-1]:
            delete(spark, f"{day}/batch_id={n}")


def _drop_old_runs(spark: SparkSession, out_dir: str, runs: list[int]) -> None:
    if not runs:
        return
    for name in list_names(spark, out_dir):
        if name.startswith("day="):
            for n in _versions(spark, f"{out_dir}/{name}"):
                if n >> RUN_BITS in runs:
                    delete(spark, f"{out_dir}/{name}/batch_id={n}")
    forget_runs(spark, out_dir, runs)


def current_table(spark: SparkSession, out_dir: str) -> DataFrame:
    """The result table: one row per (day, category)."""
    rows = _read_result(spark, out_dir)
    if rows is None:
        rows = spark.createDataFrame([], _RESULT_SCHEMA)
    run = current_run(spark, out_dir)
    shown = F.col("batch_id").between(run << RUN_BITS, ((run + 1) << RUN_BITS) - 1)
    return _newest(rows.where(shown)).select("day", "event_type", "n_events", "volume")


def run_daily_counts(
    spark: SparkSession,
    source: str,
    watermark: str = "1 day",
    max_files_per_trigger: int | None = None,
    out_dir: str | None = None,
    checkpoint_dir: str | None = None,
    schema: str | None = TABLE_SCHEMAS["events"],
    state_partitions: int | None = None,
    max_bytes_per_trigger: int | None = BATCH_BYTES,
) -> DataFrame:
    """Process every file available under ``source`` (a Parquet file or
    folder of the ``events`` schema), then return the result table.

    ``schema`` is the source's schema (default: the ``events`` schema; None
    infers it from the files).  A micro-batch reads ``max_files_per_trigger``
    files, or by default ``max_bytes_per_trigger``.  ``state_partitions``
    fixes the number of state-store partitions of a new query (AQE cannot
    coalesce stateful shuffles); None uses ``spark.sql.shuffle.partitions``.

    Rows dropped as late by this run raise a ``LateRowsWarning`` with their
    number, added up over its last 10,000 micro-batches.

    Folders default to fresh ones under the shared ``spark.checkpoint.dir``.
    Passing the same ``checkpoint_dir`` again continues the same query, in its
    ``out_dir``, with only the files that arrived since.  A new checkpoint
    reads the whole source again: its result replaces what ``out_dir`` held.
    """
    check_zone(spark)
    out_dir, checkpoint_dir, run = open_run(spark, "stream", out_dir, checkpoint_dir)
    stream = file_stream(spark, source, schema, max_files_per_trigger, max_bytes_per_trigger)
    writer = (
        daily_counts_stream(stream, watermark)
        .writeStream.outputMode("update")
        .foreachBatch(_merge_writer(out_dir, run))
        .option("checkpointLocation", checkpoint_dir)
    )
    run_to_end(spark, writer, watermark, state_partitions)
    _drop_old_runs(spark, out_dir, finish_run(spark, out_dir, run))
    return current_table(spark, out_dir)

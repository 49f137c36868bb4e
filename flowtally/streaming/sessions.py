"""Sessions per actor, as a stream.

``session_window`` keeps an actor's open sessions as state and merges what new
events join.  A session is closed, and appended to the result, once the
watermark has passed its end by the gap; a closed session never changes.  The
open ones stay in the state store, from where the state data source reads them:
the table is what was appended, and what is still open beside it.

Rows older than the watermark are dropped, and counted in a warning.  Rows that
repeat an ``event_id`` inside the watermark count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.functions import cents, from_cents
from flowtally.operators.sessions import GAP
from flowtally.sources.tables import TABLE_SCHEMAS
from flowtally.streaming.runs import delete, finish_run, forget_runs, list_names, open_run, read_run, run_dir
from flowtally.streaming.source import BATCH_BYTES, check_zone, file_stream, run_to_end, timed_once

SESSION_SCHEMA = "user_id bigint, session_start timestamp_ntz, session_end timestamp_ntz, n_events bigint, volume double"
OPERATOR = "sessionWindowStateStoreSaveExec"
# Sessions are merged within each task before the shuffle, so an actor with a
# third of a batch's rows sends one row per session and task.
CONF = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def session_stream(stream: DataFrame, gap: int = GAP, watermark: str = "1 day") -> DataFrame:
    """The streaming aggregation (append mode)."""
    rows = timed_once(stream.where(F.col("user_id").isNotNull()), watermark)
    window = F.session_window("event_time", f"{gap} microseconds").alias("w")
    sums = rows.groupBy("user_id", window).agg(F.count(F.lit(1)).alias("n_events"), F.sum(cents("value")).alias("vol"))
    return sums.select("user_id", *_times("w", gap), "n_events", from_cents("vol").alias("volume"))


def _times(window: str, gap: int):
    start, end = F.unix_micros(F.col(f"{window}.start")), F.unix_micros(F.col(f"{window}.end")) - F.lit(gap)
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return time(start).alias("session_start"), time(end).alias("session_end")


def open_sessions(spark: SparkSession, checkpoint_dir: str, gap: int = GAP) -> DataFrame:
    """Sessions that the state of the last finished batch still holds."""
    ids = [r.operatorId for r in spark.read.format("state-metadata").load(checkpoint_dir).where(F.col("operatorName") == OPERATOR).collect()]
    state = spark.read.format("statestore").option("operatorId", ids[0]).load(checkpoint_dir).select("value.*")
    names = ["user_id", "w", "n_events", "vol"]
    return state.toDF(*names).select("user_id", *_times("w", gap), "n_events", from_cents("vol").alias("volume"))


def run_sessions(
    spark: SparkSession,
    source: str,
    gap: int = GAP,
    watermark: str = "1 day",
    max_files_per_trigger: int | None = None,
    out_dir: str | None = None,
    checkpoint_dir: str | None = None,
    schema: str | None = TABLE_SCHEMAS["events"],
    state_partitions: int | None = None,
    max_bytes_per_trigger: int | None = BATCH_BYTES,
) -> DataFrame:
    """Process every file available under ``source``, then return all sessions,
    with ``closed`` (false: the state still holds them, and later files may
    extend them).  Arguments are those of ``run_daily_counts``; ``gap`` is in
    microseconds and must stay the same for a checkpoint."""
    check_zone(spark)
    out_dir, checkpoint_dir, run = open_run(spark, "sessions", out_dir, checkpoint_dir)
    stream = file_stream(spark, source, schema, max_files_per_trigger, max_bytes_per_trigger)
    writer = (
        session_stream(stream, gap, watermark)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", run_dir(out_dir, run))
        .option("checkpointLocation", checkpoint_dir)
    )
    run_to_end(spark, writer, watermark, state_partitions, CONF)
    retire(spark, out_dir, run)
    closed = read_run(spark, out_dir, SESSION_SCHEMA).withColumn("closed", F.lit(True))
    return closed.unionByName(_open(spark, checkpoint_dir, gap).withColumn("closed", F.lit(False)))


def _open(spark: SparkSession, checkpoint_dir: str, gap: int) -> DataFrame:
    if not list_names(spark, f"{checkpoint_dir}/state"):  # no row has come yet
        return spark.createDataFrame([], SESSION_SCHEMA)
    return open_sessions(spark, checkpoint_dir, gap)


def retire(spark: SparkSession, out_dir: str, run: int) -> None:
    """Show an appending sink's run, and delete the older ones."""
    old = finish_run(spark, out_dir, run)
    for n in old:
        delete(spark, run_dir(out_dir, n))
    forget_runs(spark, out_dir, old)


def closed_sessions(spark: SparkSession, out_dir: str) -> DataFrame:
    """What readers of the folder see: the closed sessions."""
    return read_run(spark, out_dir, SESSION_SCHEMA)

"""Shared parts of the streams: file source, repeated events, running to the
end, late rows."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 256 << 30  # read by one micro-batch, unless files are counted


class LateRowsWarning(UserWarning):
    """Rows were older than the watermark and are not in the result."""


_RETENTION = "spark.sql.streaming.numRecentProgressUpdates"


def check_zone(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        raise ValueError("streams need spark.sql.session.timeZone=UTC")


def file_stream(
    spark: SparkSession, source: str, schema: str | None, max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = BATCH_BYTES
) -> DataFrame:
    """Parquet files of ``source`` (a file or a folder) as a stream, oldest
    first.  A micro-batch takes ``max_files_per_trigger`` files if given, else
    ``max_bytes_per_trigger`` (one file at least)."""
    static = (spark.read.schema(schema) if schema else spark.read).parquet(source)
    reader = spark.readStream.schema(static.schema)
    source = source.rstrip("/")
    name = source.rsplit("/", 1)[-1]
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        # ``source`` is a single file, but the file source watches folders:
        # watch its folder, admitting only files with this name.
        reader = reader.option("pathGlobFilter", name)
        source = source.rsplit("/", 1)[0]
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    elif max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.parquet(source)


def timed_once(stream: DataFrame, watermark: str, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Rows with a ``ts``, as ``event_time`` under ``watermark``; a repeated
    ``event_id`` inside the watermark counts once, rows without an id are all
    kept."""
    timed = stream.where(F.col(ts).isNotNull()).withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", watermark)
    once = timed.where(F.col(event_id).isNotNull()).dropDuplicatesWithinWatermark([event_id])
    return once.unionByName(timed.where(F.col(event_id).isNull()))


def _late_rows(query) -> int:
    """Rows the stateful operators of a finished run dropped as late.  Late
    rows without an id reach them as one per day, category and task."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_to_end(spark: SparkSession, writer, watermark: str, state_partitions: int | None = None, conf: dict[str, str] | None = None) -> None:
    """Process everything available, then stop; raises what the query raised
    and warns with the number of late rows.

    Settings are applied to the session only while the query starts, since a
    stream copies the session's settings then.  ``state_partitions`` is kept in
    the checkpoint for restarts."""
    start_conf = {_RETENTION: "10000", **(conf or {})}
    if state_partitions:
        start_conf["spark.sql.shuffle.partitions"] = str(state_partitions)
    previous = {key: spark.conf.get(key, None) for key in start_conf}
    for key, setting in start_conf.items():
        spark.conf.set(key, setting)
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        for key, setting in previous.items():
            spark.conf.unset(key) if setting is None else spark.conf.set(key, setting)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"stream failed: {query.exception()}")
    if late := _late_rows(query):
        warnings.warn(f"{late} rows older than the watermark ({watermark}) were left out", LateRowsWarning, stacklevel=3)

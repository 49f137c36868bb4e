"""Hourly totals kept as a table and extended by what is new.

The source is a folder of days (``dt=YYYY-MM-DD``), the result a folder of days
(``day=...``) with a row per category and hour.  Every row says what it was made
from: the number, bytes and newest time of the day's source files.  A refresh
compares that with the source as it is and computes only the days that differ,
so a day that got more files, or lost some, is made again and the rest is not
read.  Totals and provenance of a day are written by one task's commit: a
refresh that dies is simply run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.functions import cents, from_cents
from flowtally.sources.tables import TABLE_SCHEMAS

STORED = (
    "event_type string, hour int, n_events bigint, cents bigint, "
    "source_files bigint, source_bytes bigint, source_modified bigint, day date"
)


def _folders(spark: SparkSession, path: str, key: str) -> dict[str, tuple[int, int, int]]:
    """Per ``key=`` folder: number, bytes and newest time of its files (a few
    numbers per day; names only, no data is read)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for folder in fs.listStatus(root) if fs.exists(root) else ():
        name = folder.getPath().getName()
        if folder.isDirectory() and name.startswith(f"{key}="):
            files = [f for f in fs.listStatus(folder.getPath()) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
            if files:
                out[name[len(key) + 1 :]] = (len(files), sum(f.getLen() for f in files), max(f.getModificationTime() for f in files))
    return out


def stored_rollup(spark: SparkSession, path: str) -> DataFrame | None:
    if not _folders(spark, path, "day"):
        return None
    return spark.read.schema(STORED).parquet(path)


def refresh_hourly_rollup(spark: SparkSession, source: str, path: str, schema: str = TABLE_SCHEMAS["events"]) -> list[str]:
    """Bring the table under ``path`` up to date with the days under
    ``source``; returns the days that were computed.  A row's day is its
    folder; rows without a time are counted under a null hour."""
    now = _folders(spark, source, "dt")
    before = {}
    if (stored := stored_rollup(spark, path)) is not None:
        made_from = stored.groupBy("day").agg(*(F.max(c).alias(c) for c in ("source_files", "source_bytes", "source_modified")))
        before = {str(r.day): tuple(r)[1:] for r in made_from.collect()}  # a row per day
    todo = sorted(day for day, files in now.items() if before.get(day) != files)
    if todo:
        rows = spark.read.option("basePath", source).schema(f"{schema}, dt string").parquet(*(f"{source}/dt={day}" for day in todo))
        totals = rows.groupBy(F.col("dt").cast("date").alias("day"), "event_type", F.hour("ts").alias("hour")).agg(
            F.count(F.lit(1)).alias("n_events"), F.sum(cents("value")).alias("cents")
        )
        made = spark.createDataFrame([(day, *now[day]) for day in todo], "d string, source_files long, source_bytes long, source_modified long")
        (
            totals.join(made, F.col("day") == F.col("d").cast("date"))
            .drop("d")
            .repartition("day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(path)
        )
    for day in set(before) - set(now):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return todo


def hourly_totals(stored: DataFrame) -> DataFrame:
    """``(day, event_type, hour, n_events, volume)`` of a stored rollup."""
    return stored.select("day", "event_type", "hour", "n_events", from_cents("cents").alias("volume"))


def period_totals(stored: DataFrame, grain: str = "week") -> DataFrame:
    """Totals per day, ISO week or month and category, from the stored hours:
    the events are not read."""
    period = F.col("day") if grain == "day" else F.trunc("day", grain)
    rows = stored.groupBy(period.alias("bucket_start"), "event_type")
    return rows.agg(F.sum("n_events").alias("n_events"), from_cents(F.sum("cents")).alias("volume"))

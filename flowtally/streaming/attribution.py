"""Pairs of a cause and a later effect of the same actor, as a stream-stream
join (for example a purchase within an hour of a click).

Both sides carry a watermark and the join a time range, from which Spark knows
when a row can find no more partners and leaves the state.  Besides the actor,
rows meet by time bins as long as the range: an effect lies in the cause's bin
or in the next, where the cause is filed too.  So every pair meets exactly
once, and the rows of a very active actor are spread over bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.sources.tables import TABLE_SCHEMAS
from flowtally.streaming.runs import open_run, read_run, run_dir
from flowtally.streaming.sessions import retire
from flowtally.streaming.source import BATCH_BYTES, check_zone, file_stream, run_to_end, timed_once

PAIR_SCHEMA = "user_id bigint, cause_id bigint, effect_id bigint, cause_ts timestamp_ntz, effect_ts timestamp_ntz"
HOUR = 3_600_000_000  # microseconds


def attribution_stream(events: DataFrame, effects: DataFrame, cause: str, effect: str, within: int = HOUR, watermark: str = "1 day") -> DataFrame:
    """``PAIR_SCHEMA`` rows: each ``effect`` event with each ``cause`` event of
    its actor at most ``within`` microseconds before it (not earlier than it,
    and less than ``within`` later).  ``events`` and ``effects`` are streams of
    the events table; rows without actor, time or id take no part."""

    def side(stream: DataFrame, category: str, name: str) -> DataFrame:
        rows = stream.where((F.col("event_type") == category) & F.col("user_id").isNotNull() & F.col("event_id").isNotNull())
        rows = timed_once(rows, watermark).select(F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id"), F.col("event_time").alias(f"{name}_time"))
        return rows.withColumn(f"{name}_bin", F.floor(F.unix_micros(f"{name}_time") / F.lit(within)))

    causes = side(events, cause, "cause")
    causes = causes.withColumn("cause_bin", F.explode(F.array(F.col("cause_bin"), F.col("cause_bin") + 1)))
    met = (F.col("cause_user") == F.col("effect_user")) & (F.col("cause_bin") == F.col("effect_bin"))
    range_ = F.expr(f"effect_time >= cause_time AND effect_time < cause_time + INTERVAL '{within / 1e6:f}' SECOND")
    pairs = causes.join(side(effects, effect, "effect"), met & range_)
    time = lambda c: F.col(c).cast("timestamp_ntz")
    return pairs.select(F.col("cause_user").alias("user_id"), "cause_id", "effect_id", time("cause_time").alias("cause_ts"), time("effect_time").alias("effect_ts"))


def run_attribution(
    spark: SparkSession,
    source: str,
    cause: str,
    effect: str,
    within: int = HOUR,
    watermark: str = "1 day",
    max_files_per_trigger: int | None = None,
    out_dir: str | None = None,
    checkpoint_dir: str | None = None,
    schema: str | None = TABLE_SCHEMAS["events"],
    state_partitions: int | None = None,
    max_bytes_per_trigger: int | None = BATCH_BYTES,
) -> DataFrame:
    """Process every file available under ``source`` and return all pairs
    found so far.  Arguments are those of ``run_daily_counts``."""
    check_zone(spark)
    out_dir, checkpoint_dir, run = open_run(spark, "attribution", out_dir, checkpoint_dir)
    streams = [file_stream(spark, source, schema, max_files_per_trigger, max_bytes_per_trigger) for _ in range(2)]
    writer = (
        attribution_stream(*streams, cause, effect, within, watermark)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", run_dir(out_dir, run))
        .option("checkpointLocation", checkpoint_dir)
    )
    run_to_end(spark, writer, watermark, state_partitions)
    retire(spark, out_dir, run)
    return read_run(spark, out_dir, PAIR_SCHEMA)

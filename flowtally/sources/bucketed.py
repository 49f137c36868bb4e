"""Bucketed tables: written once by a key, joined on it without a shuffle.

Two tables with the same number of buckets on their join key lie side by side:
Spark reads bucket i of both in one task and merges them.  For tables that are
joined again and again (lines with their orders) the shuffle is paid once, when
they are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """``df`` as the table ``name`` with its files under ``path``, one sorted
    file per bucket of ``keys``; returns the table."""
    spark = df.sparkSession
    (
        df.repartition(buckets, *keys)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(name)
    )
    return spark.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table written by ``write_bucketed`` (with these ``keys`` and
    ``buckets``) in another session, whose catalog does not know it yet."""
    columns = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({columns}) SORTED BY ({columns}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)

"""Compute the dashboard tables and write them as Parquet.

    python -m flowtally.plans.publish <table_dir> <out_dir> [name ...]

Each query is an independent Spark job that reads only the columns it needs;
its result is written to ``<out_dir>/<name>`` (overwritten), where a
dashboard reads it back.  Results are aggregates, so the writes are small;
the work is in the scans and shuffles of each job.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from flowtally.plans.catalog import QUERIES
from flowtally.sources import write_result
from flowtally.sources.tables import TABLE_SCHEMAS, check_tables, table_exists


def publish(spark: SparkSession, table_dir: str, out_dir: str, names: Iterable[str] | None = None) -> list[str]:
    """Write the named queries (all by default); returns the written paths.
    Tables that are there but differ from their declared schema are refused."""
    there = [t for t in TABLE_SCHEMAS if table_exists(spark, table_dir, t)]
    check_tables(spark, table_dir, *there)
    written = []
    for name in names or QUERIES:
        path = f"{out_dir.rstrip('/')}/{name}"
        write_result(QUERIES[name](spark, table_dir), path)
        written.append(path)
    return written


def main(argv: list[str]) -> int:
    if len(argv) < 2:
        print(__doc__)
        return 2
    from flowtally.session import build_session

    spark = build_session()
    for path in publish(spark, argv[0], argv[1], argv[2:] or None):
        print(path)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

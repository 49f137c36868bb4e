"""Reading query results from a SQL warehouse over JDBC.

This is the public ``spark.read.format("jdbc")`` reader.  The driver JAR of
the warehouse must be on the classpath; none is bundled, and no warehouse is
reachable from the test environment, so this reader is not exercised by the
tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_warehouse_query(
    spark: SparkSession,
    url: str,
    query: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Run ``query`` in the warehouse and expose its rows as a DataFrame.

    Without a partition column the result arrives through one JDBC
    connection (one task); give ``partition_column`` with bounds to split the
    read into ``num_partitions`` parallel range queries.  Spark's ``query``
    option cannot be combined with partitioning, so the partitioned form wraps
    the query as a derived table in ``dbtable``.
    """
    reader = spark.read.format("jdbc").option("url", url)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column is None:
        return reader.option("query", query).load()
    if lower_bound is None or upper_bound is None or not num_partitions:
        raise ValueError("partitioned reads need lower_bound, upper_bound and num_partitions")
    return (
        reader.option("dbtable", f"({query}) flowtally_q")
        .option("partitionColumn", partition_column)
        .option("lowerBound", str(lower_bound))
        .option("upperBound", str(upper_bound))
        .option("numPartitions", str(num_partitions))
        .load()
    )

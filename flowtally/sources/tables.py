"""Parquet table access.

Tables are read lazily with ``spark.read.parquet``; Catalyst prunes the
columns each query needs and pushes its filters into the scan, so the
loaders never select or filter themselves.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Table names of the input layout: one ``<name>.parquet`` per table.
TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


# The input schemas (column names and types of the driver's
# tables).  Reading with a declared schema skips Spark's schema-inference job
# (one per load).  A column that a file lacks, or has under another name, then
# reads as null; ``check_tables`` finds that (the publish job calls it once).
TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
        "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table_path(base_dir: str, name: str) -> str:
    return os.path.join(base_dir, f"{name}.parquet")


def table_exists(spark: SparkSession, base_dir: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(base_dir, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load_table(spark: SparkSession, base_dir: str, name: str, infer_schema: bool = False) -> DataFrame:
    """Lazy DataFrame over ``<base_dir>/<name>.parquet`` (file or folder),
    read with the declared schema when the table has one."""
    reader = spark.read
    if name in TABLE_SCHEMAS and not infer_schema:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(table_path(base_dir, name))


def load_tables(spark: SparkSession, base_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: load_table(spark, base_dir, name) for name in names}


def check_tables(spark: SparkSession, base_dir: str, *names: str) -> None:
    """Raises if a table's files do not have the declared columns (in any
    order, more are allowed) with the declared types: reads file footers."""
    for name in names:
        declared = spark.createDataFrame([], TABLE_SCHEMAS[name]).schema
        found = {f.name: f.dataType for f in spark.read.parquet(table_path(base_dir, name)).schema}
        wrong = [f"{f.name} {f.dataType.simpleString()}" for f in declared if found.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"table {name} lacks {', '.join(wrong)}; it has {', '.join(found)}")


def register_views(spark: SparkSession, base_dir: str, *names: str) -> None:
    """Register tables as temp views so ``spark.sql`` can name them."""
    for name in names or TABLES:
        load_table(spark, base_dir, name).createOrReplaceTempView(name)

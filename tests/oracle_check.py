"""Compare a Spark result with DuckDB SQL on the same Parquet tables:
row count, column names and types, and exact values ignoring row order."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
from pyspark.sql import DataFrame

_TYPE_MAP = {
    "LongType": "BIGINT",
    "IntegerType": "INTEGER",
    "DoubleType": "DOUBLE",
    "StringType": "VARCHAR",
    "DateType": "DATE",
    "TimestampNTZType": "TIMESTAMP",
    "BooleanType": "BOOLEAN",
}

VIEWS = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connect(table_dir: str, names=VIEWS) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in names:
        path = os.path.join(table_dir, f"{name}.parquet")
        if os.path.isdir(path):  # a table written as a folder of part files
            path = os.path.join(path, "*.parquet")
        elif not os.path.exists(path):
            continue
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((x is None, "" if x is None else str(type(x)), x if x is not None else 0) for x in row)


def compare(spark_df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Return a list of differences (empty when equal)."""
    problems = []
    s_fields = {f.name: _TYPE_MAP.get(type(f.dataType).__name__, str(f.dataType)) for f in spark_df.schema.fields}
    rel = con.sql(sql)
    d_fields = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if sorted(s_fields) != sorted(d_fields):
        return [f"columns differ: spark={sorted(s_fields)} duckdb={sorted(d_fields)}"]
    for name in s_fields:
        if s_fields[name] != d_fields[name]:
            problems.append(f"type of {name}: spark={s_fields[name]} duckdb={d_fields[name]}")
    cols = sorted(s_fields)
    s_rows = [tuple(_norm(r[c]) for c in cols) for r in spark_df.select(*cols).collect()]
    d_rows = [tuple(_norm(v) for v in r) for r in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()]
    if len(s_rows) != len(d_rows):
        problems.append(f"row count spark={len(s_rows)} duckdb={len(d_rows)}")
    s_sorted = sorted(s_rows, key=_key)
    d_sorted = sorted(d_rows, key=_key)
    if s_sorted != d_sorted:
        diff = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems

"""Result writers: the tables a dashboard reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_result(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
) -> None:
    """Write a result as Parquet.

    With ``partition_by`` the folder is split per key value (for example per
    ``bucket_start`` month) and only the partitions present in ``df`` are
    replaced, so a daily refresh does not rewrite history.
    """
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)

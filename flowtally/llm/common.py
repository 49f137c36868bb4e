"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.session import shared_dir, unique_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``<sf_dir>/<name>.parquet`` through Spark's reader (any
    Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so extra or
    clashing columns never reach it.  The text travels as its UTF-8 bytes."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"),
    )


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column has it (in any
    case), so that helper columns never replace a user's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def write_table(df: DataFrame, kind: str) -> DataFrame:
    """Cut lineage: write to a fresh folder under ``spark.checkpoint.dir``
    (shared, so it survives lost executors) and read it back."""
    spark = df.sparkSession
    path = unique_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_pieces(batches: Iterable[pa.RecordBatch], max_bytes: int = 4 << 20, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches holding about ``max_bytes`` of text (at least
    one row each), so a task's Python memory does not follow the batch size."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    """True for rows whose crc32 of the id's decimal text falls in ``fold``
    (a null id is never held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def filter_by_text(docs: DataFrame, keep: Callable[[list[bytes | None]], list[bool]], text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns unchanged, for whose texts ``keep`` says
    so; a narrow pass, nothing is shuffled.  ``keep`` gets about 1 MB of text
    at once, since its arrays can be 50 times as large."""

    def run(batches):
        for b in text_pieces(batches, 1 << 20, text_col):
            mask = keep(b.column(text_col).cast(pa.binary()).to_pylist())
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def text_buckets(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> tuple[DataFrame, int]:
    """``(bucket, doc_id, text)`` dealt into buckets of about ``bucket_bytes``
    of text, and their number.  The bucket follows from the row alone, copies
    spread by their id, and null texts become empty.  Several uses of the
    result in one query share a single shuffle, which holds each text deflated
    (``bucket_texts`` inflates)."""
    source = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(b"")))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(16, -(-size // bucket_bytes))
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")

    def deflate(batches):
        for b in batches:
            packed = [zlib.compress(t, 1) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("doc_id"), pa.array(packed, pa.binary())], ["bucket", "doc_id", "text"])

    rows = source.select(bucket.alias("bucket"), "doc_id", "text").mapInArrow(deflate, "bucket int, doc_id long, text binary")
    return rows.repartition(n, "bucket"), n


def bucket_texts(rows: pa.Table | pa.RecordBatch) -> list[bytes]:
    """Texts of rows of ``text_buckets``."""
    return [zlib.decompress(t) for t in rows.column("text").to_pylist()]


def per_bucket(rows: DataFrame, fn: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn(bucket, texts)`` for each bucket of ``text_buckets``; a task holds
    the few buckets of its partition."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for k, t in zip(b.column("bucket").to_pylist(), bucket_texts(b)):
                held.setdefault(k, []).append(t)
        while held:
            k, data = held.popitem()
            yield from fn(k, data)

    return rows.mapInArrow(run, schema)

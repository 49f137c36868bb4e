"""WARC archives: write, normalise, index, read back.

``write_warc`` stores one record per page through Spark's text writer: the
record separator of WARC (two line ends) is the writer's line separator and
gzip is its compression, so each part file is one monolithic gzip stream on any
Hadoop file system.

``normalise`` inflates every file's stream once, piece by piece, rewrites each
record as a gzip member of its own and emits, in the same pass, a sidecar index
(one JSON line per record: offset and length of its member).  Both go out
through the text writer again, in two folders, with the NUL byte as separator:
the last byte of a gzip member is the top byte of its size, zero for records
under 16 MiB, so a row is the member without that byte.  Larger records keep
theirs and are followed by one byte of zero padding, which the index leaves out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.llm.common import checkpoint
from flowtally.session import unique_dir

PIECE = 1 << 20
INDEX_BYTES = 4 << 20  # index lines of one member: far below 16 MiB, so it ends in a zero byte
FILE_BYTES = 256 << 20  # records of one written archive, before compression
CRLF = b"\r\n"


def write_warc(pages: DataFrame, path: str, records_per_file: int | None = None, date: str = "2024-01-01T00:00:00Z") -> None:
    """One response record per row of ``pages(page_id, url, html)`` under
    ``path``, whole files gzipped as one stream of at most ``records_per_file``
    records (by default 10,000, or as many as make ``FILE_BYTES`` at the mean
    size of a page if that is fewer).  Null html is an empty payload, a null url an empty one; line
    ends in a url are dropped."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\r\n]+", ""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit("\r\n\r\n"),
        http,
        body,
    )
    if records_per_file is None:
        mean = pages.agg(F.avg(F.octet_length(body))).first()[0] or 0
        records_per_file = max(1, min(10_000, int(FILE_BYTES / (mean + 500))))
    (
        pages.select(record.alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _inflated(content: bytes) -> Iterator[bytes]:
    """The inflated stream in pieces (one or more members; NUL padding between
    members is skipped)."""
    view, at = memoryview(content), 0
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        inflate = zlib.decompressobj(31)
        while at < len(view) and not inflate.eof:
            chunk = view[at : at + PIECE]
            at += len(chunk)
            out = inflate.decompress(chunk, PIECE)
            while out:
                yield out
                # after the end, the tail is already in unused_data
                out = inflate.decompress(inflate.unconsumed_tail, PIECE) if inflate.unconsumed_tail and not inflate.eof else b""
        at -= len(inflate.unused_data)
        if tail := inflate.flush():
            yield tail


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _records(content: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(header bytes, header fields, block) of each record of a gzipped WARC."""
    pieces, buf = _inflated(content), bytearray()

    def fill(n: int) -> bool:
        for piece in pieces:
            buf.extend(piece)
            if len(buf) >= n:
                break
        return len(buf) >= n

    while True:
        while buf[:2] == CRLF or (len(buf) < 2 and fill(2) and buf[:2] == CRLF):
            del buf[:2]
        if not buf:
            return
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not fill(len(buf) + 1):
                raise ValueError("truncated WARC header")
        head = bytes(buf[:end])
        fields = _fields(head)
        size = int(fields["content-length"])
        if len(buf) < end + 4 + size and not fill(end + 4 + size):
            raise ValueError("truncated WARC block")
        block = bytes(buf[end + 4 : end + 4 + size])
        del buf[: end + 4 + size]
        yield head, fields, block


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The HTTP body of a response block, else the block itself."""
    if "application/http" in fields.get("content-type", ""):
        return block.partition(b"\r\n\r\n")[2]
    return block


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def normalise(spark: SparkSession, raw: str, out: str) -> None:
    """Rewrite the gzipped WARC files under ``raw`` as ``out/kind=data`` (a
    member per record) and ``out/kind=index`` (gzipped JSON lines ``id,
    offset, length, digest, payload_bytes``); files pair up by part name.
    A task holds one compressed file, the record it is at and a few MB of
    index lines."""

    def run(batches):
        seq = at = 0
        for batch in batches:
            for content in batch.column("content"):
                lines, rows, held, noted = [], [], 0, 0
                for head, fields, block in _records(content.as_py()):
                    payload = payload_of(fields, block)
                    digest = sha1_base32(payload)
                    keep = [x for x in head.split(CRLF) if not x.lower().startswith(b"warc-payload-digest:")]
                    member = _member(CRLF.join([*keep, b"WARC-Payload-Digest: sha1:" + digest.encode()]) + b"\r\n\r\n" + block + b"\r\n\r\n")
                    row = member[:-1] if member[-1] == 0 else member
                    entry = {"id": fields.get("warc-record-id", ""), "offset": at, "length": len(member), "digest": digest, "payload_bytes": len(payload)}
                    lines.append((json.dumps(entry, ensure_ascii=False) + "\n").encode())
                    noted += len(lines[-1])
                    rows.append(("data", seq, row))
                    at, seq, held = at + len(row) + 1, seq + 1, held + len(row)
                    if noted > INDEX_BYTES:
                        rows.append(("index", seq, _member(b"".join(lines))[:-1]))
                        lines, noted = [], 0
                    if held > 8 * PIECE:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows([*rows, ("index", seq, _member(b"".join(lines))[:-1])])

    def _rows(rows):
        kind, seq, row = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(seq, pa.int64()), pa.array(row, pa.binary())], ["kind", "seq", "row"])

    (
        spark.read.format("binaryFile").load(raw).select("content")
        .mapInArrow(run, "kind string, seq long, row binary")
        .sortWithinPartitions("kind", "seq")
        .select("kind", F.col("row").cast("string").alias("value"))
        .write.partitionBy("kind").option("lineSep", "\0").text(out)
    )


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """The sidecar index as rows ``(part, id, offset, length, digest, payload_bytes)``."""

    def run(batches):
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content")):
                lines = [json.loads(x) for x in b"".join(_inflated(content.as_py())).split(b"\n") if x]
                names = ["id", "offset", "length", "digest", "payload_bytes"]
                yield pa.RecordBatch.from_pylist([{"part": part, **{k: x[k] for k in names}} for x in lines], schema=schema)

    schema = pa.schema([("part", pa.string()), ("id", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64())])
    return _files(spark, out, "index").mapInArrow(run, "part string, id string, offset long, length long, digest string, payload_bytes long")


def _files(spark: SparkSession, out: str, kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(f"{out}/kind={kind}")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("part"), "content")


def read_warc(spark: SparkSession, out: str, index: DataFrame | None = None) -> DataFrame:
    """``(id, url, payload)`` of the indexed records (all of them, or the rows
    of ``read_index`` passed), each inflated alone at its offset."""
    index = read_index(spark, out) if index is None else index
    wanted = index.groupBy("part").agg(F.collect_list(F.struct("offset", "length")).alias("at"))  # bounded by the file

    def run(batches):
        schema = pa.schema([("id", pa.string()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content, spots in zip(batch.column("content"), batch.column("at")):
                data, rows, held = content.as_py(), [], 0
                for spot in spots.as_py():
                    (_, fields, block), = _records(data[spot["offset"] : spot["offset"] + spot["length"]])
                    rows.append({"id": fields["warc-record-id"], "url": fields["warc-target-uri"], "payload": payload_of(fields, block)})
                    held += len(block)
                    if held > 8 * PIECE:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _files(spark, out, "data").join(wanted, "part").mapInArrow(run, "id string, url string, payload binary")


def _measured(payloads: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest)`` of read-back records."""

    def run(batches):
        for b in batches:
            payload = b.column("payload").to_pylist()
            ids = [int(d) if (d := x[len("<urn:page:") : -1]) else None for x in b.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(p) for p in payload], pa.int64()), pa.array([sha1_base32(p) for p in payload])],
                ["page_id", "payload_bytes", "payload_digest"],
            )

    return payloads.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string")


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``record_type`` and ``refers_to``: of records with equal payloads
    of at least ``min_bytes`` bytes the largest page_id is the response and the
    others revisit it.  Repeated rows of that page_id are all the response; a
    group without any page_id is all response."""
    records = checkpoint(records)
    latest = checkpoint(
        records.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("latest"), F.count("*").alias("copies"))
        .where("copies > 1 AND latest IS NOT NULL")
        .select("payload_digest", "latest")
    )
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return records.join(latest, "payload_digest", "left").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("latest")).alias("refers_to"),
    )


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise and index them, read
    every record back through the index and mark revisits.  An empty table
    gives no rows."""
    spark = pages.sparkSession
    raw, out = unique_dir(spark, "warc-raw"), unique_dir(spark, "warc")
    if pages.isEmpty():
        return mark_revisits(spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string"), min_bytes)
    write_warc(pages, raw)
    normalise(spark, raw, out)
    return mark_revisits(_measured(read_warc(spark, out)), min_bytes)

from __future__ import annotations

import gzip
import os
import random

from flowtally.llm import warc
from tests.llm import brute

SCHEMA = "page_id long, url string, html string, digest string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_round_trip(spark):
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", "<p>" + "é日x " * rng.randrange(60) + "</p>" * (i % 3), "clash") for i in range(200)]
    pages += [(500, None, None, None), (501, "u\r\nInjected: 1", "", None), (502, "u", "\r\n\r\nWARC/1.1\r\n\r\n\0", None)]
    pages += [(None, "u", "<p>x", None), (503, "u", "<p>x", None), (504, "u", "<p>x", None), (504, "u", "<p>x", None)]
    pages += [(None, "u", "only without id", None), (None, "u", "only without id", None)]
    df = spark.createDataFrame(pages, SCHEMA).repartition(5)
    got = warc.warc_round_trip(df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows(got) == sorted(brute.op2([(p, h) for p, _, h, _ in pages]), key=str)


def test_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_min_bytes(spark):
    df = spark.createDataFrame([(1, "u", "abc", ""), (2, "u", "abc", ""), (3, "u", "", ""), (4, "u", "", "")], SCHEMA)
    got = {r.page_id: r.record_type for r in warc.warc_round_trip(df, min_bytes=1).collect()}
    assert got == {1: "revisit", 2: "response", 3: "response", 4: "response"}


def test_archives_index_and_large_records(spark, tmp_path):
    """Members stand at their indexed offsets, files are plain gzip, and a
    record of more than 16 MiB (whose member does not end in a zero) works."""
    big = random.Random(0).randbytes(9 << 20).hex()
    df = spark.createDataFrame([(1, "a", "one", ""), (2, "b", big, ""), (3, "c", "three", "")], SCHEMA).coalesce(1)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_warc(df, raw)
    whole = [f for f in os.listdir(raw) if f.endswith(".gz")]
    assert len(whole) == 1 and gzip.open(f"{raw}/{whole[0]}").read().count(b"WARC-Type: response") == 3
    warc.normalise(spark, raw, out)
    index = warc.read_index(spark, out).collect()
    assert [r.id for r in sorted(index, key=lambda r: r.offset)] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    for r in index:
        data = open(f"{out}/kind=data/{r.part}", "rb").read()
        member = gzip.decompress(data[r.offset : r.offset + r.length])
        assert r.id.encode() in member and f"WARC-Payload-Digest: sha1:{r.digest}".encode() in member
    assert gzip.open(f"{out}/kind=data/{index[0].part}").read().count(b"WARC/1.1") == 3
    only = warc.read_warc(spark, out, warc.read_index(spark, out).where("id = '<urn:page:2>'")).collect()
    assert [bytes(r.payload) for r in only] == [big.encode()]


def test_records_over_several_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * i, "") for i in range(50)], SCHEMA).coalesce(2)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_warc(df, raw, records_per_file=7)
    warc.normalise(spark, raw, out)
    got = warc.read_warc(spark, out).collect()
    assert sorted(len(r.payload) for r in got) == list(range(50))


def test_index_of_several_members(spark, tmp_path, monkeypatch):
    """Index lines go out a member every so many bytes; the file is plain gzip
    and every line is there."""
    monkeypatch.setattr(warc, "INDEX_BYTES", 5000)
    df = spark.createDataFrame([(i, "u", f"page {i}", "") for i in range(3000)], SCHEMA).coalesce(1)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_warc(df, raw)
    warc.normalise(spark, raw, out)
    part = next(f for f in os.listdir(f"{out}/kind=index") if f.startswith("part"))
    data = open(f"{out}/kind=index/{part}", "rb").read()
    assert data.count(b"\x1f\x8b\x08") > 50 and gzip.decompress(data).count(b"\n") == 3000
    index = warc.read_index(spark, out)
    assert index.count() == 3000 and warc.read_warc(spark, out, index).count() == 3000


def test_an_index_of_more_than_16_mib(spark, tmp_path, monkeypatch):
    """Long ids: the lines of one file are more than a member's size field
    holds without its last byte."""
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 40)
    df = spark.range(9000).selectExpr("id AS page_id", "'u' AS url", "'x' AS html", "'' AS digest").coalesce(1)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    long_ids = df.selectExpr("concat(page_id, repeat('i', 2000)) AS page_id", "url", "html")
    warc.write_warc(long_ids, raw)
    warc.normalise(spark, raw, out)
    part = next(f for f in os.listdir(f"{out}/kind=index") if f.startswith("part"))
    assert len(gzip.open(f"{out}/kind=index/{part}").read()) > 17 << 20
    assert warc.read_index(spark, out).count() == 9000


def test_members_that_inflate_to_several_pieces():
    data = [bytes([65 + k]) * (3 * warc.PIECE + k) for k in range(4)]
    packed = b"".join(warc._member(x) + b"\0" * k for k, x in enumerate(data))
    assert b"".join(warc._inflated(packed)) == b"".join(data)


def test_files_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 30_000)
    df = spark.createDataFrame([(i, "u", "x" * 9500, "") for i in range(30)], SCHEMA).coalesce(1)
    warc.write_warc(df, str(tmp_path / "raw"))
    assert len([f for f in os.listdir(tmp_path / "raw") if f.endswith(".gz")]) == 10

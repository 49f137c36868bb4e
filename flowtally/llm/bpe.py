"""Byte-level BPE with every distinct word encoded once.

A task splits its documents into pre-tokens, in buckets of bounded text size,
and numbers each bucket's distinct words; a document becomes the sequence of
its word numbers.  A bucket sends its words, packed, to the parts that their
hashes name.  A part gathers a word from all buckets, encodes it once and sends
its ids back to the buckets that asked.  There the ids are joined to the word
numbers and the documents are reassembled by position.  Decoding joins the ids
with the token-byte table, again once for each distinct word.

Texts are split once and never travel: only word numbers do, and distinct words
(a blob per bucket and part holds one word or more, so blobs stay below the
buckets' distinct words).  The rank table has one entry per id of the
vocabulary file, however large the corpus, and is sent to the executors.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.llm.common import text_pieces, texts


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """``{token bytes: rank}`` from a rank file (a base64 token and its rank
    per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the lowest-ranked neighbouring pair (the leftmost of equals) until
    none has a rank.  Candidate pairs wait in a heap over a linked list, so a
    very long word costs n log n."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # piece i is word[i:end[i]]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not alive[i] or mid >= n or end[mid] != stop:
            continue  # one of the two pieces has grown or gone
        alive[mid] = 0
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (before := prev[i]) >= 0 and (r := ranks.get(word[before:stop])) is not None:
            heapq.heappush(heap, (r, before, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


SEPARATOR = b"\xff"  # no UTF-8 text holds this byte
NUMBERS = -1  # the part of a bucket's word numbers
SPLIT = "bucket string, part int, blob binary, of array<int>, ids array<bigint>, sizes array<int>"


def _id_type(end: int) -> type:
    """Narrowest type for ids and the mark ``end`` behind each word's."""
    return np.uint16 if end < 1 << 16 else np.uint32


def _planes(numbers: np.ndarray) -> bytes:
    """The numbers' first, second, ... bytes apart: the higher ones are mostly
    zero."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


class _Bucket:
    """Word numbers of the documents of one bucket."""

    def __init__(self, name: str):
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.name, self.digest = name, hashlib.blake2b(digest_size=16)
        self.ids, self.sizes, self.numbers, self.bytes = [], [], [], 0

    def add(self, doc_id: int | None, text: bytes, findall) -> None:
        words = findall(text.decode("utf-8", "replace"))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.numbers.append(np.fromiter(map(self.index.__getitem__, words), np.uint32, len(words)))
        self.digest.update(b"%d:" % len(text) + text)
        self.bytes += len(text)

    def rows(self, parts: int) -> pa.RecordBatch:
        """A row of word numbers, then the words of each part.  The name holds
        a digest of the texts: should a lost task's documents come in another
        order the second time, its words and numbers could not be mixed up."""
        numbers = np.concatenate([np.zeros(0, np.uint32), *self.numbers])
        self.numbers.clear()
        # Frequent words get the small numbers.
        by_count = np.argsort(-np.bincount(numbers, minlength=len(self.index)), kind="stable")
        rank = np.empty(len(by_count), np.uint32)
        rank[by_count] = np.arange(len(by_count))
        known = list(self.index)
        words = [known[i].encode() for i in by_count.tolist()]
        of = np.array([zlib.crc32(w) % parts for w in words], np.int32)
        order = np.argsort(of, kind="stable")
        full, begin = np.unique(of[order], return_index=True)
        packed = [zlib.compress(SEPARATOR.join([words[i] for i in at.tolist()]), 1) for at in np.split(order, begin[1:])] if words else []
        n, name = len(packed), f"{self.name}-{self.digest.hexdigest()}"
        columns = [[name] * (n + 1), [NUMBERS, *full.tolist()], [_planes(rank[numbers]), *packed], [of, *[None] * n], [self.ids, *[None] * n], [self.sizes, *[None] * n]]
        types = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in SPLIT.split(", ")])


def _split(docs: DataFrame, parts: int, pattern: str, bucket_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``SPLIT``, by bucket; several uses in one query share one
    exchange."""

    def run(batches):
        findall, task, made = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        bucket = _Bucket(f"{task}-0")
        for batch in text_pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or b""
                if bucket.ids and bucket.bytes + len(text) > bucket_bytes:
                    yield bucket.rows(parts)
                    made += 1
                    bucket = _Bucket(f"{task}-{made}")
                bucket.add(doc_id, text, findall)
        if bucket.ids:
            yield bucket.rows(parts)

    return texts(docs, id_col, text_col).mapInArrow(run, SPLIT).repartition(parts, "bucket")


def _encoded(split: DataFrame, ranks) -> DataFrame:
    """``(bucket, part, blob)``: for each bucket and part the ids of the
    bucket's distinct words of that part, in the words' order."""

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        table, known, blobs = ranks.value, {}, []
        end = max(table.values(), default=0) + 1
        for blob in frame["blob"]:
            flat = []
            for w in zlib.decompress(blob).split(SEPARATOR):
                if (got := known.get(w)) is None:
                    got = known[w] = (*encode_word(w, table), end)
                flat += got
            blobs.append(zlib.compress(np.array(flat, _id_type(end)).tobytes(), 1))
        return pd.DataFrame({"bucket": frame["bucket"], "part": frame["part"], "blob": blobs})

    def words(batches):
        for b in batches:
            yield b.filter(pc.not_equal(b.column("part"), NUMBERS)).select(["bucket", "part", "blob"])

    # A filter or a projection of Spark's would move below the exchange, which
    # then could not be shared: the texts would be split a second time.
    asked = split.mapInArrow(words, "bucket string, part int, blob binary")
    return asked.groupBy("part").applyInPandas(encode, "bucket string, part int, blob binary")


def _reassembled(docs: DataFrame, ranks_path: str, pattern: str, bucket_bytes: int, id_col: str, text_col: str, row, schema: str) -> DataFrame:
    """``row(ids, raw)(numbers)`` of each document: per word number its ids and
    their bytes, and the document's word numbers in order."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(spark, ranks_path))  # a vocabulary, whatever the corpus
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    split = _split(docs, max(16, -(-size // bucket_bytes)), pattern, bucket_bytes, id_col, text_col)
    coded = _encoded(split, ranks)
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [arrow[x.split()[1]] for x in schema.split(", ")]

    def join(bucket: pa.Table, replies: pa.Table) -> pa.Table:
        token = {i: b for b, i in ranks.value.items()}  # the token-byte table
        end = max(token, default=0) + 1
        held = bucket.filter(pc.equal(bucket.column("part"), NUMBERS))
        of = held["of"][0].values.to_numpy()
        ids: list = [None] * len(of)
        # A part's replies are in the order of the numbers of its words.
        order = np.argsort(of, kind="stable")
        at = dict(zip(*(x.tolist() for x in np.unique(of[order], return_index=True))))
        for part, blob in zip(replies.column("part").to_pylist(), replies.column("blob").to_pylist()):
            flat = np.frombuffer(zlib.decompress(blob), _id_type(end))
            ends = np.flatnonzero(flat == end)
            flat, begin = flat.tolist(), 0
            for i, stop in zip(order[at[part] : at[part] + len(ends)].tolist(), ends.tolist()):
                ids[i], begin = flat[begin:stop], stop + 1
        raw = [token[x[0]] if len(x) == 1 else b"".join([token[i] for i in x]) for x in ids]
        one, numbers = row(ids, raw), _numbers(held["blob"][0].as_buffer())
        out = [one(x) for x in np.split(numbers, np.cumsum(held["sizes"][0].as_py())[:-1])]
        columns = [held["ids"][0].as_py(), *zip(*out)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return split.groupBy("bucket").cogroup(coded.groupBy("bucket")).applyInArrow(join, schema)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every whole text, each match of
    ``pattern`` encoded separately and no special tokens.  Null and empty texts
    have no ids; repeated rows are encoded each."""

    def row(ids, _):
        def one(numbers):
            flat = [i for w in numbers.tolist() for i in ids[w]]
            return len(flat), flat

        return one

    return _reassembled(docs, ranks_path, pattern, bucket_bytes, id_col, text_col, row, "doc_id long, n_tokens long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, text)`` as bytes: the ids' token bytes, concatenated.  Null
    ids give an empty text; an id outside the vocabulary is an error."""
    spark = encoded.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(spark, ranks_path))

    def run(batches):
        token = {i: b for b, i in ranks.value.items()}
        for b in batches:
            out = [b"".join([token[i] for i in x or ()]) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text binary")


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids
    (decimal, comma-joined) and of the bytes they decode to."""

    def row(ids, raw):
        text = [",".join(map(str, x)).encode() for x in ids]
        size = np.array([len(x) for x in ids], np.int64)

        def one(numbers):
            words = numbers.tolist()
            flat = hashlib.sha256(b",".join([text[w] for w in words])).hexdigest()
            decoded = hashlib.sha256(b"".join([raw[w] for w in words])).hexdigest()
            return int(size[numbers].sum()), flat, decoded

        return one

    return _reassembled(docs, ranks_path, pattern, bucket_bytes, "doc_id", "text", row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

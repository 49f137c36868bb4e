"""SimHash near-duplicates through Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each
read as a word of the perfect (23,12) Golay code.  With at most four differing
bits, pigeonhole leaves one of two cases for some pair of segments:

* both differ in at most one bit: the codeword nearest to x's segment lies
  within distance four of y's segment, and the other way round;
* one segment is equal (and the other two differ in two bits each): the
  segments of the other differ in at most two bits, so some codeword lies
  within distance four of both.

A word has one nearest codeword (distance at most three) and at most five more
at distance four.  Joining one side's nearest codewords with the other side's
four-ball codewords finds every pair; the join condition verifies the distance
on the whole fingerprint, so nothing else comes out.  Only distinct
fingerprints are joined: a group of equal texts is one row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.llm.common import checkpoint, free_names, text_pieces, texts
from flowtally.llm.components import connected_components

MAX_BITS = 4  # what the three segments are proven for
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, width)
KEYED_AT_ONCE = 2000  # fingerprints; each has some 65 keys

# Fixed value: generator polynomial of the binary (23,12) Golay code.
GOLAY_GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY_GENERATOR << (bit - 11)
    return word


def _ball_table() -> tuple[np.ndarray, np.ndarray]:
    """Per 11-bit syndrome: the error patterns of weight up to four (lightest
    first, the coset leader), and how many there are."""
    unit = [_remainder(1 << b) for b in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = pattern = 0
            for b in bits:
                syndrome ^= unit[b]
                pattern |= 1 << b
            found[syndrome].append(pattern)
    width = max(map(len, found))
    table = np.zeros((2048, width), np.int64)
    for s, patterns in enumerate(found):
        table[s, : len(patterns)] = patterns
    return table, np.array([len(p) for p in found])


class GolayKeys:
    """Codeword indices (12 bits) near a word of up to 23 bits."""

    def __init__(self):
        self.table, self.count = _ball_table()
        self.low = np.array([_remainder(i) for i in range(1 << 12)], np.int64)
        self.high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.int64)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.table[self.syndrome(words), 0]) >> 11

    def ball(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of every codeword within distance four."""
        s = self.syndrome(words)
        n = self.count[s]
        row = np.repeat(np.arange(len(words)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, (words[row] ^ self.table[s[row], nth]) >> 11


def _fingerprint(data: bytes | None, shingle_words: int) -> int:
    words = data.lower().split() if data else []  # bytes.lower: A-Z only; split: 0x20, 0x09-0x0D
    if not words:
        return 0
    total, ones = max(1, len(words) - shingle_words + 1), np.zeros(64, np.int64)
    for at in range(0, total, 1 << 15):
        hashes = [
            xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle_words]), 42)
            for i in range(at, min(at + (1 << 15), total))
        ]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big", signed=True)


def simhash_fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: 64-bit SimHash of each whole text over word shingles
    (lower-cased A-Z, repeats included).  Texts without words, empty or null
    have fingerprint zero; a text shorter than a shingle is one shingle."""

    def run(batches):
        for b in text_pieces(batches, 1 << 20):
            fps = [_fingerprint(t, shingle_words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _keyed(fps: DataFrame, left: bool) -> DataFrame:
    """``(key, fp)`` rows of one side of the candidate join."""

    def run(batches):
        golay = GolayKeys()
        for b in (b.slice(at, KEYED_AT_ONCE) for b in batches for at in range(0, b.num_rows, KEYED_AT_ONCE)):
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            word = fp.view(np.uint64)
            seg = [(word >> np.uint64(at) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS]
            near, ball = [golay.nearest(s) for s in seg], [golay.ball(s) for s in seg]
            rows, keys = [], []
            for tag, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))):
                if left:  # nearest of i, any of j
                    row, index = ball[j]
                    keys.append(near[i][row] << 12 | index | tag << 40)
                else:  # any of i, nearest of j
                    row, index = ball[i]
                    keys.append(index << 12 | near[j][row] | tag << 40)
                rows.append(row)
                row, index = ball[j]  # i equal, any of j
                keys.append(seg[i][row] << 12 | index | (tag + 3) << 40)
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp[np.concatenate(rows)])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def simhash_links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct-fingerprint pairs ``(a, b)`` at ``max_bits`` or fewer differing
    bits, a < b; ``fps`` has distinct ``fp``.  A pair may come out once per
    shared key."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    left, right = _keyed(fps, True).withColumnRenamed("fp", "a"), _keyed(fps, False).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.join(right, (left.key == right.key) & (F.col("a") < F.col("b")) & near).select("a", "b")


def _components(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, component, component_id)`` of every distinct fingerprint of
    ``fps`` (``doc_id, fp``): ``component`` names its group, ``component_id``
    is the group's smallest doc_id (null if all are)."""
    reps = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = checkpoint(connected_components(simhash_links(reps, max_bits)))
    member = reps.join(groups, reps.fp == groups.node, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")
    )
    member = checkpoint(member)
    smallest = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    return checkpoint(member.join(smallest, "component").select("fp", "component", "component_id"))


def simhash_groups(
    docs: DataFrame, shingle_words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row: the smallest
    doc_id reachable over fingerprints at ``max_bits`` or fewer differing bits.
    Null ids link like others but are never a component_id (null if all are)."""
    fps = checkpoint(simhash_fingerprints(docs, shingle_words, id_col, text_col))
    return fps.join(_components(fps, max_bits), "fp").select("doc_id", "fp", "component_id")


def near_duplicate_groups(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """``simhash_groups`` with the fingerprint as 16 lower-case hex digits."""
    return simhash_groups(docs, shingle_words, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _row_key(doc_id: str, text: str) -> Column:
    """16 bytes that name a row's id and text; null and empty texts are told apart."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(doc_id), F.lit(" "), part(text)).cast("binary")))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each group stays: that of its smallest doc_id (of the group's
    rows repeating that id, the first text in byte order).  Rows without an id
    stay.  The smallest id is found on ids and keys of rows; texts are compared
    only where rows repeat it."""

    def run(batches):
        for b in text_pieces(batches, 1 << 20):
            fps = [_fingerprint(t, shingle_words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), _row_key("doc_id", "text").alias("key"))
    fps = checkpoint(keyed.mapInArrow(run, "doc_id long, key binary, fp long"))
    first = fps.join(_components(fps, max_bits), "fp").where("doc_id = component_id")
    first = checkpoint(first.groupBy("component", "key").agg(F.count("*").alias("n")))
    rows = first.groupBy("component").agg(F.sum("n").alias("rows"))
    first = first.join(rows, "component").select("key", "component", "rows")
    names = free_names(docs, "key", "component", "rows", "row")
    key, component, rows, row = names
    kept = docs.withColumn(key, _row_key("doc_id", "text")).join(first.toDF(*names[:3]), key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    several = kept.where(F.col(rows) > 1).groupBy(component).agg(F.min_by(F.struct(*columns), F.struct("text")).alias(row))
    return kept.where(F.col(rows) == 1).select(*columns).unionByName(several.select(f"{row}.*")).unionByName(docs.where("doc_id IS NULL"))

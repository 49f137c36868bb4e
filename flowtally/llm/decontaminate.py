"""Benchmark decontamination by Wu-Manber search over words.

Words are numbered by the benchmark's vocabulary; every other word is number
zero and occurs in no pattern.  For all patterns of one length m, the block
shift table tells for the two words ending at a position how far a pattern's
end can be moved on at least, the suffix-hash buckets name the patterns that
end in a block of shift zero, and direct comparison of all m words confirms an
occurrence.  Windows of ten words are one set; items shorter than a window form
one set for each of the lengths one to nine.

A batch of documents is searched together: its words are cut into lanes (with
the overlap a pattern needs) and all lanes move by their own shift at every
step, so the skip loop is vectorised.

Benchmark tables are searched in blocks: items are dealt by hash into blocks of
about ``block_bytes`` of text; each block's tables travel with one narrow pass
over all documents, which appends its hits.  Between two blocks the documents
and their hits are written, so the driver and a task hold the tables of one
block at a time, however large the benchmark (an item is never split).
Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.llm.common import filter_by_text, text_pieces, texts, write_table

LANE = 512
# Every byte that is no word byte becomes a space; A-Z become a-z.
WORD_BYTES = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cased words ``[0-9a-z` and everything beyond ASCII``]+``."""
    return data.translate(WORD_BYTES).split() if data else []


class WuManber:
    """Search tables for patterns (rows of word numbers) of one length."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, self.m = patterns, patterns.shape[1]
        self.block = min(2, self.m)
        bits = max(10, math.ceil(math.log2(max(2, patterns.size * 4))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, self.m - self.block + 1, np.int32)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self.hash(patterns, end), self.m - 1 - end)
        last = self.hash(patterns, self.m - 1)  # suffix-hash buckets, as one sorted array
        self.order = np.argsort(last, kind="stable")
        self.last = last[self.order]

    def hash(self, rows: np.ndarray, end: int) -> np.ndarray:
        h = rows[:, end].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if self.block == 2:
            h ^= rows[:, end - 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h >> np.uint64(29) & self.mask).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence in ``text`` (separators are a
        number no pattern holds)."""
        m, n = self.m, len(text)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.arange(m - 1, n, LANE)
        stop = np.minimum(ends + LANE, n)
        starts, which = [], []
        while len(ends):
            block = text[ends][:, None] if self.block == 1 else np.stack([text[ends - 1], text[ends]], axis=1)
            key = self.hash(block, self.block - 1)
            move = self.shift[key]
            if len(hit := np.flatnonzero(move == 0)):
                lo, hi = np.searchsorted(self.last, key[hit], "left"), np.searchsorted(self.last, key[hit], "right")
                size = hi - lo
                at = np.repeat(ends[hit], size) - (m - 1)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
                pattern = self.order[np.repeat(lo, size) + nth]
                for step in range(0, len(at), 1 << 16):
                    a, p = at[step : step + (1 << 16)], pattern[step : step + (1 << 16)]
                    same = (text[a[:, None] + np.arange(m)] == self.patterns[p]).all(axis=1)
                    starts.append(a[same])
                    which.append(p[same])
            ends = ends + np.maximum(move, 1)
            live = ends < stop
            ends, stop = ends[live], stop[live]
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(which)


class Searcher:
    """All patterns of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set[str]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(item)
        self.sets = [(WuManber(np.array(list(p), np.int32)), [sorted(x) for x in p.values()]) for _, p in sorted(by_length.items())]

    def hits(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Per document the spans (start, end) of occurrences and their items."""
        get = self.vocabulary.get
        # number 0: a word of no item; -1 between documents
        text = np.array([x for words in docs for x in (*(get(w, 0) for w in words), -1)], np.int32)
        begin = np.cumsum([0, *(len(w) + 1 for w in docs)])
        out = [([], set()) for _ in docs]
        for table, items in self.sets:
            start, pattern = table.search(text)
            doc = np.searchsorted(begin, start, "right") - 1
            for d, s, p in zip(doc.tolist(), (start - begin[doc]).tolist(), pattern.tolist()):
                out[d][0].append((s, s + table.m))
                out[d][1].update(items[p])
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searchers(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Searcher]:
    """Search tables of the benchmark, a block of items at a time."""
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else items
        yield Searcher([(r.item, bytes(r.text)) for r in part.toLocalIterator()], window)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "doc_id long, text binary, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _search_block(found: DataFrame, searcher: Searcher) -> DataFrame:
    def run(batches):
        for b in text_pieces(batches):
            docs = [words_of(t) for t in b.column("text").to_pylist()]
            hits = searcher.hits(docs)
            spans = [
                [{"start": s, "end": e} for s, e in _merged(new + [(x["start"], x["end"]) for x in old])]
                for (new, _), old in zip(hits, b.column("spans").to_pylist())
            ]
            items = [sorted({*new, *old}) for (_, new), old in zip(hits, b.column("items").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), pa.array(map(len, docs), pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "text", "n_words", "spans", "items"],
            )

    return found.mapInArrow(run, FOUND)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    block_bytes: int = 4 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, spans, items)`` per row of ``docs``: the word spans
    inside occurrences of benchmark windows and the ids (as text) of the items
    they belong to.  Null and empty texts have no words and no hits; items
    without words or without an id match nothing; an empty benchmark hits
    nothing."""
    found = texts(docs, id_col, text_col).selectExpr(
        "doc_id", "text", "0L AS n_words",
        "CAST(array() AS array<struct<start:bigint,end:bigint>>) AS spans", "CAST(array() AS array<string>) AS items",
    )
    for k, searcher in enumerate(_searchers(benchmark, window, block_bytes)):
        found = _search_block(write_table(found, "benchmark-hits") if k else found, searcher)
    return found.drop("text")


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row: word, hit and item counts, and whether any word is hit.  Null
    and empty texts have no words; rows with null or repeated ids are rows of
    their own; no documents give no rows, an empty benchmark no hits; columns
    that are not named are never read."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return benchmark_hits(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, unchanged (all columns), in which no word is hit;
    rows without a text stay."""
    for k, searcher in enumerate(_searchers(benchmark, window, block_bytes)):
        docs = filter_by_text(write_table(docs, "uncontaminated") if k else docs, lambda data, s=searcher: [not spans for spans, _ in s.hits([words_of(t) for t in data])])
    return docs

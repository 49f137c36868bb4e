"""Repeated substrings of ``window`` words, found through difference covers.

The set D = {0, 1, 3, 9} holds every difference modulo 13.  So for any two
places p and q there is a step d < 13 with p + d and q + d both in D modulo 13:
two equal windows of 20 words always share an equal anchor of 8 words whose
place in either document is a cover position.  Only anchors at cover positions
(4 of 13) are hashed and counted over the corpus.  A window that holds no
repeated anchor is unique; the others are extended: their whole window (128-bit
hash) is compared over the corpus, and the earliest (doc_id, start) of equal
windows is the original.

Documents are dealt into buckets.  A bucket sends its distinct hashes only (of
equal windows its earliest), packed by hash into parts; a part compares the
buckets and answers each.  So a passage that a third of all documents share
travels once per bucket, and what is repeated within a bucket is settled there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from flowtally.llm.common import bucket_texts, per_bucket, text_buckets
from flowtally.llm.words import constants, hash_words, in_sorted, mix, word_edges

PERIOD, COVER = 13, (0, 1, 3, 9)  # a perfect difference set
NO_ID = np.iinfo(np.int64).max  # rows without an id come last
PIECE = 1 << 20

class Bucket:
    """Words of a bucket's documents as hashes, one array for all."""

    def __init__(self, texts: list[bytes], seeds: tuple[int, ...]):
        hashes: list[list[np.ndarray]] = [[] for _ in seeds]
        counts = []
        for piece in _pieces(texts):
            data = np.frombuffer(b" ".join(piece), np.uint8)
            start, end = word_edges(data)
            begin = np.cumsum([0, *(len(t) + 1 for t in piece)])
            counts.append(np.diff(np.searchsorted(start, begin)))
            if len(start):
                for out, seed in zip(hashes, seeds):
                    out.append(hash_words(data, start, end, seed))
        self.seeds = seeds
        self.hashes = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in hashes]
        self.size = np.concatenate(counts) if counts else np.zeros(0, np.int64)  # words per document
        self.first = np.cumsum(self.size) - self.size
        self.doc = np.repeat(np.arange(len(texts)), self.size)
        self.place = np.arange(len(self.doc)) - self.first[self.doc]

    def starts(self, length: int) -> np.ndarray:
        """Words at which ``length`` words of one document begin."""
        return np.flatnonzero(self.place + length <= self.size[self.doc])

    def spans(self, starts: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each start."""
        base = constants(self.seeds[which])[2]
        h, out, power = self.hashes[which], np.zeros(len(starts), np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(length):
                out += h[starts + k] * power
                power = power * base
        return mix(out)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the anchors at cover positions."""
        length = window - PERIOD + 1
        starts = self.starts(length)
        starts = starts[np.isin(self.place[starts] % PERIOD, COVER)]
        return starts, self.spans(starts, length)

    def repeated_windows(self, window: int, elsewhere: np.ndarray) -> np.ndarray:
        """Starts of windows with an anchor that is repeated here or is in
        ``elsewhere`` (sorted)."""
        at, h = self.anchors(window)
        known = in_sorted(h, elsewhere)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        known[order[1:][same]] = True
        known[order[:-1][same]] = True
        mark = np.zeros(len(self.doc) + 1, np.int32)
        hit = at[known]
        np.add.at(mark, np.maximum(hit - (PERIOD - 1), self.first[self.doc[hit]]), 1)
        np.add.at(mark, hit + 1, -1)
        starts = self.starts(window)
        return starts[np.cumsum(mark)[starts] > 0]


def _pieces(texts: list[bytes]):
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > PIECE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


PACKED = "bucket int, part int, blob binary"
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("at", "<i4")])


def _parts(bucket: int, rows: np.ndarray, key: np.ndarray, parts: int) -> pa.Table:
    part = (key >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    full = [p for p in range(parts) if cut[p] < cut[p + 1]]
    blobs = [rows[order[cut[p] : cut[p + 1]]].tobytes() for p in full]
    return pa.table([pa.array([bucket] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "part", "blob"])


def _answers(frame: pd.DataFrame, rows: list[np.ndarray]) -> pd.DataFrame:
    full = [i for i, r in enumerate(rows) if len(r)]
    return pd.DataFrame({"bucket": frame["bucket"].iloc[full].astype("int32"), "part": frame["part"].iloc[full].astype("int32"), "blob": [rows[i].tobytes() for i in full]})


def _split(flags: np.ndarray, values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    at = np.cumsum([0, *sizes])
    return [values[a:b][flags[a:b]] for a, b in zip(at, at[1:])]


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Anchors of a part that two buckets or more have sent."""
    sent = [np.frombuffer(x, "<u8") for x in frame["blob"]]
    flat = np.concatenate(sent)
    order = np.argsort(flat, kind="stable")
    same = flat[order][1:] == flat[order][:-1]
    flag = np.zeros(len(flat), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return _answers(frame, _split(flag, flat, [len(x) for x in sent]))


def _later(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows of a part whose earliest place is in another bucket."""
    sent = [np.frombuffer(x, WINDOW) for x in frame["blob"]]
    flat = np.concatenate(sent)
    order = np.lexsort((flat["at"], flat["doc"], flat["b"], flat["a"]))
    s = flat[order]
    same = (s["a"][1:] == s["a"][:-1]) & (s["b"][1:] == s["b"][:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    lead = np.flatnonzero(np.concatenate([[True], ~same]))[group]
    flag = np.zeros(len(flat), bool)
    flag[order] = (s["doc"] != s["doc"][lead]) | (s["at"] != s["at"][lead])
    pairs = np.empty(len(flat), PAIR)
    pairs["a"], pairs["b"] = flat["a"], flat["b"]
    return _answers(frame, _split(flag, pairs, [len(x) for x in sent]))


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)


def _removed(bucket: Bucket, ids: np.ndarray, window: int, later: np.ndarray) -> np.ndarray:
    """Mask of words covered by a window that also starts earlier; ``later``
    are the windows known from other buckets."""
    starts = bucket.starts(window)
    a, b = bucket.spans(starts, window, 0), bucket.spans(starts, window, 1)
    doc, at = ids[bucket.doc[starts]], bucket.place[starts]
    flag = np.zeros(len(starts), bool)
    if len(later):
        later = np.sort(later, order=("a", "b"))
        lo, hi = np.searchsorted(later["a"], a, "left"), np.searchsorted(later["a"], a, "right")
        for i in np.flatnonzero(hi > lo) if (hi - lo).max() > 1 else ():
            flag[i] = (later["b"][lo[i] : hi[i]] == b[i]).any()
        one = np.flatnonzero(hi == lo + 1)
        flag[one] = later["b"][lo[one]] == b[one]
    order = np.argsort(a, kind="stable")
    twin = np.zeros(len(a), bool)
    same = a[order][1:] == a[order][:-1]
    twin[1:] |= same
    twin[:-1] |= same
    few = order[twin]  # windows that share a hash within the bucket
    few = few[np.lexsort((at[few], doc[few], b[few], a[few]))]
    if len(few):
        new = np.concatenate([[True], (a[few][1:] != a[few][:-1]) | (b[few][1:] != b[few][:-1])])
        lead = few[np.flatnonzero(new)[np.cumsum(new) - 1]]
        flag[few] |= (doc[few] != doc[lead]) | (at[few] != at[lead])
    mark = np.zeros(len(bucket.doc) + 1, np.int32)
    hit = starts[flag]
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + window, -1)
    return np.cumsum(mark)[:-1] > 0


def dedup_substrings(
    docs: DataFrame, window: int = 20, bucket_bytes: int = 8 << 20, digest: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row: the text without the
    words covered by a window of ``window`` words that also starts earlier
    (smaller doc_id, or earlier in the document), kept words joined by one
    space; with ``digest`` the SHA-256 of that as ``kept_sha256``.  Windows are
    judged on the input.  Null and empty texts have no words.  Rows that repeat
    a doc_id are the same document, rows without an id come after all others."""
    if window < PERIOD + 1:
        raise ValueError(f"window must be {PERIOD + 1} words or more")
    rows, n = text_buckets(docs, id_col, text_col, bucket_bytes)

    def send_anchors(bucket, data):
        _, h = Bucket(data, (1,)).anchors(window)
        h = np.unique(h)
        yield from _parts(bucket, h, h, n).to_batches()

    def send_windows(texts: pa.Table, shared: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _parts(0, np.zeros(0, WINDOW), np.zeros(0, np.uint64), n)
        bucket, ids = Bucket(bucket_texts(texts), (1, 2)), _ids(texts)
        elsewhere = np.sort(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in shared.column("blob").to_pylist())]))
        starts = bucket.repeated_windows(window, elsewhere)
        w = np.empty(len(starts), WINDOW)
        w["a"], w["b"] = bucket.spans(starts, window, 0), bucket.spans(starts, window, 1)
        w["doc"], w["at"] = ids[bucket.doc[starts]], bucket.place[starts]
        w = w[np.lexsort((w["at"], w["doc"], w["b"], w["a"]))]
        first = np.ones(len(w), bool)
        first[1:] = (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1])
        w = w[first]
        return _parts(texts.column("bucket")[0].as_py(), w, w["a"], n)

    def remove(texts: pa.Table, later: pa.Table) -> pa.Table:
        data = bucket_texts(texts)
        bucket = Bucket(data, (1, 2))
        known = np.concatenate([np.zeros(0, PAIR), *(np.frombuffer(x, PAIR) for x in later.column("blob").to_pylist())])
        gone = _removed(bucket, _ids(texts), window, known)
        kept, removed = [], []
        for text, at, size in zip(data, bucket.first, bucket.size):
            mask = gone[at : at + size]
            removed.append(int(mask.sum()))
            words = text.split()
            joined = b" ".join([w for w, x in zip(words, mask.tolist()) if not x] if removed[-1] else words)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "replace"))
        return pa.table(
            [texts.column("doc_id"), pa.array(bucket.size, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"],
        )

    def with_texts(answers: DataFrame, fn, schema: str) -> DataFrame:
        return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(fn, schema)

    shared = per_bucket(rows, send_anchors, PACKED).groupBy("part").applyInPandas(_shared, PACKED)
    later = with_texts(shared, send_windows, PACKED).groupBy("part").applyInPandas(_later, PACKED)
    return with_texts(later, remove, f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")

"""How far the sources of a language differ in the terms they use.

A task takes its documents in shards of bounded size.  Over a shard's Arrow
text buffer it builds one pointer per token start and sorts the pointers by the
token's bytes with a multikey quicksort whose characters are eight bytes wide:
a slice is split into less, equal and greater around a pivot character, the
equal part goes on with the next character, and a slice small enough for the
cache is sorted outright.  Runs of equal tokens then give each term's count and
document frequency per source, so a shard sends one row per (language, source,
term) however often the term occurs.

Scores are whole numbers throughout.  For a pair of sources the sum over all
terms is put together from three parts, so that only terms which both sources
hold are looked at pair by pair, inside a task: a term without occurrences has
the same share everywhere in its source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.llm.common import text_pieces, write_table

SCALE = 1_000_000_000
STEPS = (31_250, 32_000)  # their product is SCALE
SLICE = 1 << 17  # pointers sorted outright
PAIRS = 1 << 20  # pairs of one step, and sums held by a task

#: Lower-cased letters; bytes of characters beyond ASCII stay, others are 0.
LETTERS = np.zeros(256, np.uint8)
LETTERS[0x61:0x7B] = LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)


class Tokens:
    """Token-start pointers over the concatenated texts of a shard."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        """``data``: the texts' bytes; ``edges``: where each text begins, and
        the end of the last."""
        self.data = np.concatenate([LETTERS[data], np.zeros(16, np.uint8)])
        letter = self.data[: len(data)] != 0
        before, after = np.concatenate([[False], letter[:-1]]), np.concatenate([letter[1:], [False]])
        inner = edges[(edges > 0) & (edges < len(data))]
        before[inner] = False
        after[inner - 1] = False
        self.start = np.flatnonzero(letter & ~before)
        self.length = np.flatnonzero(letter & ~after) + 1 - self.start
        self._words = np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,))

    def chars(self, pointers: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes of each token from ``depth`` on, zero after its end."""
        left = np.minimum(self.length[pointers] - depth, 8)
        shift = (8 * (8 - np.maximum(left, 1))).astype(np.uint64)
        word = self._words[self.start[pointers] + depth].astype(np.uint64)
        return np.where(left > 0, word >> shift << shift, np.uint64(0))

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Pointers in byte order of their tokens, and flags where a new token
        begins."""
        order, new = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        stack = [(np.arange(len(self.start)), 0)]
        while stack:
            pointers, depth = stack.pop()
            if depth is None:  # all one token
                first = np.arange(len(pointers)) == 0
            elif len(pointers) > SLICE:
                key = self.chars(pointers, depth)
                pivot = np.sort(key[:: len(key) // 255])[127]
                on = depth + 8 if int(pivot) & 0xFF else None
                parts = [(pointers[key > pivot], depth), (pointers[key == pivot], on), (pointers[key < pivot], depth)]
                stack += [part for part in parts if len(part[0])]
                continue
            else:
                pointers, first = self._sort_slice(pointers, depth)
            order.append(pointers)
            new.append(first)
        return np.concatenate(order), np.concatenate(new)

    def _sort_slice(self, pointers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        key = self.chars(pointers, depth)
        by = np.argsort(key)
        pointers, key = pointers[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rows = np.arange(len(pointers))
        while True:
            # Runs of one character that go on, of two tokens or more.
            run = np.cumsum(new)[rows]
            same = np.concatenate([run[1:] == run[:-1], [False]])
            same[1:] |= same[:-1].copy()
            on = same & (key & np.uint64(0xFF) != 0)
            rows, run = rows[on], run[on]
            if not len(rows):
                return pointers, new
            depth += 8
            key = self.chars(pointers[rows], depth)
            by = np.lexsort((key, run))
            pointers[rows], key = pointers[rows][by], key[by]
            new[rows[1:]] |= key[1:] != key[:-1]

    def bytes_of(self, pointers: np.ndarray) -> pa.Array:
        """The tokens as an Arrow string column."""
        start, length = self.start[pointers], self.length[pointers]
        offsets = np.concatenate([[0], np.cumsum(length)])
        flat = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
        return pa.StringArray.from_buffers(len(pointers), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[flat]))


COUNTS = "lang string, source string, term string, n long, docs long"


def _shard_counts(batches, shard_bytes):
    """Rows of ``COUNTS``: occurrences of each term in each group of a shard,
    and the documents that hold it."""
    for shard in text_pieces(batches, shard_bytes):
        text = shard.column("text").cast(pa.large_binary())
        edges = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)[edges[0] : edges[-1]] if text.buffers()[2] else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        tokens = Tokens(data, edges)
        pointers, new = tokens.sort()
        if not len(pointers):
            continue
        # Documents are numbered so that those of a group follow each other.
        lang, source = (pc.dictionary_encode(shard.column(c)) for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        by_group = np.argsort(group, kind="stable")
        place = np.empty(len(group), np.int64)
        place[by_group] = np.arange(len(group))
        doc = place[np.searchsorted(edges, tokens.start[pointers], "right") - 1]
        seen = np.sort((np.cumsum(new) - 1) * len(group) + doc)
        run, g = seen // len(group), group[by_group][seen % len(group)]
        at = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(g, prepend=-1) != 0))
        docs = np.add.reduceat(np.diff(seen, prepend=-1) != 0, at, dtype=np.int64)
        n = np.diff(at, append=len(seen))
        terms = tokens.bytes_of(pointers[new])
        for k in range(0, len(at), 1 << 16):
            row = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(g[row] // len(source.dictionary))), source.dictionary.take(pa.array(g[row] % len(source.dictionary))),
                    terms.take(pa.array(run[row])), pa.array(n[k : k + (1 << 16)]), pa.array(docs[k : k + (1 << 16)]),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame, shard_bytes: int = 16 << 20, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, term, docs, total, held)``: document frequency and occurrences
    of each term in each language, and ``held`` its (source, n) in the sources
    that hold it.  Nulls count as empty; every row is a document."""

    def run(batches):
        yield from _shard_counts(batches, shard_bytes)

    cols = {"text": text_col, "lang": lang_col, "source": source_col}
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for name, c in cols.items()))
    # One exchange: dealt by (lang, term), both groupings find their rows.
    shards = rows.mapInArrow(run, COUNTS).repartition("lang", "term")
    by_source = shards.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held")
    )


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, of: Column) -> Column:
    """``1 + floor(SCALE (n + 1) / of)``, in two steps, so that longs hold it
    for up to 2.9e14 tokens; null if ``of`` is 0."""
    a, b = map(F.lit, STEPS)
    of = F.nullif(of, F.lit(0).cast("long"))
    first = a * (n + 1)
    return F.lit(1) + b * _div(first, of) + _div(b * (first % of), of)


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _group_totals(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Every occurring (lang, source), even without terms: ``n`` occurrences
    and ``held`` number of its kept terms, ``v`` kept terms and ``lang_n``
    occurrences of the language."""
    every = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for name, c in (("lang", lang_col), ("source", source_col)))).distinct()
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    by_group = kept.select("lang", F.explode("held").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"), F.count("*").alias("held"))
    totals = every.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    # p0 is the share of a term that the source does not hold.
    return write_table(totals.withColumn("p0", _share(F.lit(0).cast("long"), F.col("n") + F.col("v"))), "source-groups")


def _both_held(batches):
    """Over terms held by two or more sources: what the sum over terms gains
    by both being present, per ordered pair of sources; a task holds at most
    ``PAIRS`` sums before it sends them."""
    names = ["lang", "source", "item", "value"]
    sums: dict[tuple, int] = {}

    def send():
        columns = zip(*((*pair, v) for pair, v in sums.items())) if sums else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()])], names)

    for batch in batches:
        held = batch.column("held")
        size = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        x = held.flatten()
        lang = pc.dictionary_encode(batch.column("lang"))
        source = pc.dictionary_encode(x.field("source"))
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        code, p, p0 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (source.indices, x.field("p"), x.field("p0")))
        of_lang = np.repeat(lang.indices.to_numpy().astype(np.int64), size)
        begin = np.repeat(np.cumsum(size) - size, size)
        size = np.repeat(size, size)
        ends = np.cumsum(size)
        k = 0
        while k < len(ends):  # rows k to stop, PAIRS pairs or one row's
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
            i = np.repeat(np.arange(k, stop), size[k:stop])
            j = begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(size[k:stop]) - size[k:stop], size[k:stop])
            k = stop
            i, j = i[i != j], j[i != j]
            if not len(i):
                continue
            gap = lambda a, b: (a - b) ** 2 // b
            value = gap(p[i], p[j]) - gap(p[i], p0[j]) - gap(p0[i], p[j]) + gap(p0[i], p0[j])
            key = (of_lang[i] * len(sources) + code[i]) * len(sources) + code[j]
            by = np.argsort(key)
            key, value = key[by], value[by]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            for one, v in zip(key[at].tolist(), np.add.reduceat(value, at).tolist()):
                rest, b = divmod(one, len(sources))
                pair = (langs[rest // len(sources)], sources[rest % len(sources)], sources[b])
                sums[pair] = sums.get(pair, 0) + v
            if len(sums) >= PAIRS:
                yield send()
                sums.clear()
    yield send()


def _pairs(held: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every ordered pair of sources.

    With shares p where a source holds a term and p0 where it does not, the
    sum over all kept terms of gap(p, p') is: over the source's terms
    gap(p, p0'), over the other's gap(p0, p'), gap(p0, p0') for each other
    term (those in both counted as -1), and what ``_both_held`` adds.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"), F.col("held").alias("o_held"))
    at = F.col("source") != F.col("item")
    none = groups.join(other, "lang").where(at)
    neither = none.select("lang", "source", "item", F.coalesce((F.col("v") - F.col("held") - F.col("o_held")) * _gap(F.col("p0"), F.col("o0")), F.lit(0)).alias("value"))
    # Terms of equal count in a source have equal shares.
    shares = held.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    one = shares.join(other, "lang").where(at)
    one = one.select(
        "lang",
        F.inline(
            F.array(
                F.struct("source", "item", (F.col("terms") * _gap(F.col("p"), F.col("o0"))).alias("value")),
                F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * _gap(F.col("o0"), F.col("p"))).alias("value")),
            )
        ),
    )
    by_term = held.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held")).where(F.size("held") > 1)
    both = by_term.select("lang", "held").mapInArrow(_both_held, "lang string, source string, item string, value long")
    return neither.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, min_docs: int = 3, top_terms: int = 200, shard_bytes: int = 16 << 20, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair`` holds, for each source of a language, every other source and
    the divergence of the two over all kept terms (0 if none are kept); part
    ``term`` the ``top_terms`` terms that the source uses most above its
    language.  Kept are the terms in ``min_docs`` documents of the language.
    Null texts, languages and sources count as empty; each row is a document,
    so repeated rows count again; empty texts give their group its pairs; ties
    go by the item's bytes; other columns are never read; no documents give no
    rows.
    """
    kept = write_table(term_counts(docs, shard_bytes, text_col, lang_col, source_col).where(F.col("docs") >= min_docs), "source-terms")
    groups = _group_totals(docs, kept, lang_col, source_col)
    rows = kept.select("lang", "term", "total", F.explode("held").alias("x")).select("lang", "term", "total", "x.source", F.col("x.n").alias("c"))
    held = rows.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", _share(F.col("c"), F.col("n") + F.col("v")).alias("p"), _share(F.col("total"), F.col("lang_n") + F.col("v")).alias("q")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = _pairs(held, groups).withColumn("rank", F.row_number().over(order))
    terms = held.where("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))

"""Vectors compressed to one codebook index per part (product codes).

Components become integers ``floor(256 x)``; a vector is cut into equal
consecutive parts and each part position has a codebook of at most 64 integer
entries.  The nearest entry is found by slicing and intersecting: for every
dimension of a part the entries' coordinates are sorted, and each place in that
order carries the uint64 mask of the entries before it.  A radius around the
part selects a range per dimension, the XOR of the two prefix masks names the
entries inside, and the AND over the dimensions leaves those inside the box.
Entries outside the box are farther away than the radius, so a best entry no
farther than the radius is the nearest; the other parts are asked again with a
radius that their best entry (or a doubling) gives.  All arithmetic is exact.

Rows of all tasks meet only as sums per codebook entry; what the driver holds
is the codebooks (64 x vector size integers for each vector size).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.llm.common import write_table

ENTRIES = 64  # one bit each of a uint64 mask
ROWS = 4096  # vectors handled at once by a task
LIMB = 32

Books = dict[int, list[np.ndarray]]  # vector size -> part -> entries x width


def usable(vector: str) -> Column:
    """True for vectors without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return ~F.coalesce(bad, F.lit(True))


def integers(x: np.ndarray) -> np.ndarray:
    """``floor(256 x)``: int64 where that holds it, else Python integers."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0**50:
        return np.floor(x * 256).astype(np.int64)
    whole = [int(v) * 256 if abs(v) >= 2.0**53 else math.floor(v * 256) for v in x.ravel()]
    return np.array(whole, object).reshape(x.shape)


def _narrow(entries: list, shape: tuple) -> np.ndarray:
    wide = np.array(entries, object).reshape(shape)
    return wide if any(abs(x) >> 58 for x in wide.ravel()) else wide.astype(np.int64)


def cut(q: np.ndarray, parts: int) -> list[np.ndarray]:
    """Consecutive parts; the first ones are longer by one where the size
    does not divide evenly."""
    return np.array_split(q, parts, axis=1)


def _exact(*arrays: np.ndarray) -> bool:
    """Whether 64 x squared distances of these rows fit int64."""
    width = max(1, arrays[0].shape[1])
    top = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return 4 * top * top * width * ENTRIES < 1 << 62


class Slices:
    """Sorted coordinates and prefix masks of one codebook."""

    def __init__(self, book: np.ndarray):
        self.book = book
        bit = np.uint64(1) << np.arange(len(book), dtype=np.uint64)
        self.sorted, self.before = [], []
        for column in book.T:
            order = np.argsort(column, kind="stable")
            self.sorted.append(column[order])
            self.before.append(np.concatenate([[np.uint64(0)], np.bitwise_or.accumulate(bit[order])]))
        apart = ((book[:, None] - book) ** 2).sum(axis=2)
        near = sorted(min((int(d) for d in row if d), default=1) for row in apart)
        self.radius = math.isqrt(near[len(near) // 2]) + 1

    def inside(self, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries in the box of ``radius`` around each row."""
        mask = np.full(len(q), np.uint64((1 << len(self.book)) - 1))
        for d, (coords, before) in enumerate(zip(self.sorted, self.before)):
            low = np.searchsorted(coords, q[:, d] - radius, "left")
            high = np.searchsorted(coords, q[:, d] + radius, "right")
            mask &= before[low] ^ before[high]
        return mask

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower) and its squared
        distance, for each row of ``q``."""
        kind = q.dtype
        best, error = np.zeros(len(q), np.int64), np.zeros(len(q), kind)
        if not q.shape[1]:
            return best, error
        todo, radius = np.arange(len(q)), np.full(len(q), self.radius, kind)
        while len(todo):
            mask = self.inside(q[todo], radius)
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            found = np.flatnonzero(mask)
            if len(found):
                gap = q[todo[row]] - self.book[entry]
                key = (gap * gap).sum(axis=1) * ENTRIES + entry
                first = np.minimum.reduceat(key, np.flatnonzero(np.diff(row, prepend=-1)))
                at = todo[found]
                best[at] = (first % ENTRIES).astype(np.int64)
                error[at] = first // ENTRIES
            hit = mask != 0
            sure = hit & (error[todo] <= radius * radius)
            # The best entry in the box bounds the nearest one; without any,
            # the box doubles.
            wider = radius * 2
            root = [math.isqrt(int(e)) + 1 for e in error[todo[hit & ~sure]]]
            wider[hit & ~sure] = np.array(root, kind) if root else 0
            todo, radius = todo[~sure], wider[~sure]
        return best, error


def _blocks(batch: pa.RecordBatch):
    """(row numbers, vectors as one array) per vector size."""
    cells = batch.column("embedding")
    sizes = cells.value_lengths().to_numpy(zero_copy_only=False)
    flat, start = cells.values.to_numpy(zero_copy_only=False), cells.offsets.to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for k in range(0, len(rows), ROWS):
            at = rows[k : k + ROWS]
            yield int(size), at, integers(flat[start[at][:, None] + np.arange(size)])


def _assign(books: Books):
    """``(size, q) -> per part (index, squared distance)``."""
    tables: dict[tuple, Slices] = {}

    def run(size, q):
        for p, (book, part) in enumerate(zip(books[size], cut(q, len(books[size])))):
            if book.dtype == object or part.dtype == object or not _exact(part, book):
                book, part = book.astype(object), part.astype(object)
            if (size, p, book.dtype) not in tables:
                tables[size, p, book.dtype] = Slices(book)
            yield (part, *tables[size, p, book.dtype].nearest(part))

    return run


def _first_books(kept: DataFrame, parts: int) -> Books:
    """Parts of the 64 vectors of smallest id, for each vector size."""
    order = Window.partitionBy("size").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    first = kept.withColumn("size", F.size("embedding")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= ENTRIES)
    found: dict[int, list] = {}
    for r in first.orderBy("size", "nth").collect():
        found.setdefault(r.size, []).append(r.embedding)
    return {size: cut(integers(np.array(rows, np.float64).reshape(len(rows), size)), parts) for size, rows in found.items()}


SUMS = "size int, part int, entry int, place int, limb int, value long"


def _sums(kept: DataFrame, books: Books) -> DataFrame:
    """Counts (place -1) and component sums of the parts assigned to each
    entry; a sum is split into 32-bit limbs, so that Spark adds longs."""

    def run(batches):
        assign, total = _assign(books), {}
        for batch in batches:
            for size, _, q in _blocks(batch):
                for p, (part, best, _) in enumerate(assign(size, q)):
                    k, width = len(books[size][p]), part.shape[1]
                    count, value = total.setdefault((size, p), (np.zeros(k, object), np.zeros((k, width), object)))
                    count += np.bincount(best, minlength=k)
                    order = np.argsort(best, kind="stable")
                    begin = np.flatnonzero(np.diff(best[order], prepend=-1))
                    if width:
                        value[best[order][begin]] += np.add.reduceat(part[order], begin, axis=0)
        rows = [
            (size, p, e, d, limb, (abs(v) >> (LIMB * limb) & ((1 << LIMB) - 1)) * (1 if v > 0 else -1))
            for (size, p), (count, value) in total.items()
            for e in range(len(count))
            for d, v in enumerate([int(count[e]), *map(int, value[e])], -1)
            for limb in range(-(-abs(v).bit_length() // LIMB))
        ]
        columns = list(zip(*rows)) if rows else [[]] * 6
        names, types = ["size", "part", "entry", "place", "limb", "value"], [pa.int32()] * 5 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return kept.select("embedding").mapInArrow(run, SUMS).groupBy("size", "part", "entry", "place", "limb").agg(F.sum("value").alias("value"))


def _moved(books: Books, sums: DataFrame) -> Books:
    """Entries replaced by the floored mean of their parts; unused ones stay."""
    total: dict[tuple, int] = {}
    for r in sums.collect():  # at most (64 entries) x (vector size + 16) x limbs
        key = (r.size, r.part, r.entry, r.place)
        total[key] = total.get(key, 0) + (r.value << (LIMB * r.limb))
    out: Books = {}
    for size, parts in books.items():
        out[size] = [
            _narrow(
                [[total.get((size, p, e, d), 0) // n for d in range(len(row))] if (n := total.get((size, p, e, -1))) else list(row) for e, row in enumerate(book)],
                book.shape,
            )
            for p, book in enumerate(parts)
        ]
    return out


def train_codebooks(vectors: DataFrame, parts: int = 16, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> Books:
    """Codebooks of ``parts`` part positions, ``rounds`` rounds of assignment
    and replacement over all usable vectors, for each vector size."""
    kept = _kept(vectors, id_col, vector_col)
    books = _first_books(kept, parts)
    for _ in range(rounds):
        books = _moved(books, _sums(kept, books))
    return books


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    extra = [] if label is None else [label.alias("label")]
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"), *extra)
    return rows.where(usable("embedding"))


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame, parts: int = 16, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of all vectors
    without null or non-finite components; the others (null vectors too) go.

    ``code`` has two hex digits per part, ``error`` the sum of the final
    squared distances, ``label_error`` its sum over rows of equal label (null
    labels together).  Rows with a null id come after all others when the
    first entries are chosen, and stay; repeated ids are separate rows, the
    smaller vector first.  Vectors of another size have codebooks of their
    own, uneven sizes longer first parts, and an empty vector the code of
    zeros.  A sum that a long does not hold is null, and so is the label's.  Columns that are not
    named are ignored; an empty table gives an empty result.
    """
    books = train_codebooks(vectors, parts, rounds, id_col, vector_col)
    digests = {size: books_digest(b) for size, b in books.items()}

    def encode(batches):
        assign = _assign(books)
        for batch in batches:
            n = batch.num_rows
            code, error, digest = [""] * n, [0] * n, [""] * n
            for size, at, q in _blocks(batch):
                found = [(best, gap) for _, best, gap in assign(size, q)]
                index = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
                far = sum(gap.astype(object) for _, gap in found)
                for row, i, e in zip(at.tolist(), index, far):
                    code[row], error[row], digest[row] = i.tobytes().hex(), int(e) if e < 1 << 63 else None, digests[size]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error, pa.int64()), pa.array(digest)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kept = _kept(vectors, id_col, vector_col, F.col(f"`{label_col}`"))
    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long, codebooks_sha256 string"
    coded = write_table(kept.mapInArrow(encode, schema), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.expr("if(count(error) = count(*), try_sum(error), null)").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")

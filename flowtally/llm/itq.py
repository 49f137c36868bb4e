"""Near-duplicate vectors: iterative quantisation and multi-index hashing.

A rotation is learnt on a bounded sample (of normalised vectors) so that the
signs of the rotated components are balanced binary codes.  A code of 64 bits
is cut into four words of 16 bits, one Hamming table each.  A vector is looked
up in every table under its own word and under all words one bit away, so any
two codes at seven or fewer differing bits meet in some table (at a cosine of
0.98 four of 64 bits differ on average).  Candidates whose whole codes are
near are reranked with the original vectors in double precision.

Equal vectors are one row throughout: their number counts as links, their pairs
are never made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.llm.common import checkpoint, write_table
from flowtally.llm.components import connected_components

BITS, TABLES = 64, 4


def fit_itq(sample: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 0) -> np.ndarray:
    """Projection (dimensions x bits): principal directions turned by the
    rotation that brings the projected sample closest to its own signs.
    Samples of fewer dimensions than bits get random directions besides."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    _, _, axes = np.linalg.svd(sample, full_matrices=False)
    axes = axes[:bits].T
    if axes.shape[1] < bits:
        extra = rng.normal(size=(dim, bits - axes.shape[1]))
        axes = np.concatenate([axes, extra / np.linalg.norm(extra, axis=0)], axis=1)
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    flat = sample @ axes
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (u @ v).T
    return axes @ turn


def _codes(rows: DataFrame, models: dict[int, np.ndarray]) -> DataFrame:
    """``(rep, label, dim, code)``."""

    def run(batches):
        for b in batches:
            vectors = b.column("embedding").to_pylist()
            code = np.zeros(len(vectors), np.int64)
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.array([vectors[i] for i in at], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                bits = np.packbits(x @ models[int(dim)] > 0, axis=1)
                code[at] = bits.view(">i8")[:, 0]
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("label"), pa.array(dims.astype(np.int32)), pa.array(code)], ["rep", "label", "dim", "code"]
            )

    return rows.select("rep", "label", "embedding").mapInArrow(run, "rep long, label long, dim int, code long")


def _valid(label: str, vector: str):
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity here
    nonzero = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & good & nonzero, F.lit(False))


def _cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_links(reps: DataFrame, min_cosine: float = 0.98, max_bits: int = 18, sample_rows: int = 4096) -> DataFrame:
    """Pairs ``(a, b)`` of distinct vectors ``reps(rep, label, embedding)``
    with equal labels and sizes and a cosine of ``min_cosine`` or more, a < b.
    The index is fitted on ``sample_rows`` vectors of each vector size (a few
    sizes at most) and holds every vector."""
    sized = reps.withColumn("dim", F.size("embedding"))
    models = {}
    for r in sized.select("dim").distinct().collect():
        sample = sized.where(F.col("dim") == r.dim).orderBy(F.xxhash64("rep")).limit(sample_rows).select("embedding").collect()
        x = np.array([s.embedding for s in sample], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        models[r.dim] = fit_itq(x / np.linalg.norm(x, axis=1, keepdims=True))
    codes = checkpoint(_codes(reps, models))
    width = BITS // TABLES
    words = F.array(*(F.shiftright("code", width * k).bitwiseAND((1 << width) - 1) for k in range(TABLES)))
    stored = codes.select("rep", "label", "dim", "code", F.posexplode(words).alias("table", "word"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(width)))
    probes = stored.withColumn("flip", F.explode(flips)).select(
        F.col("rep").alias("a"), "label", "dim", "table", F.col("word").bitwiseXOR(F.col("flip")).alias("word"), F.col("code").alias("code_a")
    )
    near = F.bit_count(F.col("code").bitwiseXOR(F.col("code_a"))) <= max_bits
    found = probes.join(stored, ["label", "dim", "table", "word"]).where((F.col("a") < F.col("rep")) & near)
    pairs = found.select("a", F.col("rep").alias("b")).distinct()
    vectors = reps.select("rep", F.col("embedding").cast("array<double>").alias("v"))
    both = pairs.join(vectors.withColumnsRenamed({"rep": "a", "v": "va"}), "a").join(vectors.withColumnsRenamed({"rep": "b", "v": "vb"}), "b")
    return both.where(_cosine(F.col("va"), F.col("vb")) >= min_cosine).select("a", "b")


def near_duplicate_vectors(
    rows: DataFrame, min_cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per row: ``vec_id, n_links, component_id, kept``.  Rows without
    an id, and vectors or labels that cannot be compared, link with nothing
    (component_id is their own id); repeated rows are vectors of their own."""
    source = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("embedding")
    )
    ok = F.col("vec_id").isNotNull() & _valid("label", "embedding")
    groups = source.where(ok).groupBy("label", "embedding").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("copies"))
    # a number of its own for each group (vectors may share an id), fixed by writing it
    groups = write_table(groups.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    links = checkpoint(vector_links(groups, min_cosine))
    component = connected_components(links)
    lowest = component.join(groups, component.node == groups.rep).groupBy("component").agg(F.min("smallest").alias("component_id"))
    component = component.join(lowest, "component").select("node", "component_id")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = groups.select(F.col("rep").alias("b"), "copies")
    others = both.join(size, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    member = checkpoint(
        groups.join(others, groups.rep == others.a, "left")
        .join(component, groups.rep == component.node, "left")
        .select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "smallest").alias("component_id"))
    )
    linked = source.where(ok).join(member, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = source.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))

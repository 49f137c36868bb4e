"""Connected components of an edge list, by alternating star contractions.

Each round turns every node's neighbourhood into a star around its smallest
member; the edge list never grows and the number of rounds is logarithmic.
Rows stay two longs wide.  A hub's rows are split by Spark's skew join: the
per-node minimum is written before it is joined, so both join inputs are plain
shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.llm.common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of ``edges(u, v)`` with u > v."""
    if large:
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sym = edges
    low = checkpoint(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = sym.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return checkpoint(out.where("u > v").distinct())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list;
    ``component`` is the smallest node reachable.  Null ends and self loops
    are ignored; repeated edges count once; no edges give an empty table."""
    cur = checkpoint(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        cur = _star(_star(cur, large=True), large=False)
        # Stars have as many edges as leaves; the pair of sums is unchanged
        # exactly when a round moved nothing (both stars only lower v).
        row = cur.agg(
            F.count("*").alias("n"),
            F.countDistinct("u").alias("leaves"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if tuple(row) == seen or row.n == 0:
            break
        seen = tuple(row)
    return (
        cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    )

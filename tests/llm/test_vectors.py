"""Near-duplicate vectors against brute force, on planted links."""

from __future__ import annotations

import numpy as np
import pytest

from flowtally.llm import itq
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, code string, copies int, a long, component string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, label, 1, "c", 2, 3, "d") for i, v, label in rows], SCHEMA).repartition(parts)


def got(spark, rows):
    return sorted((tuple(r) for r in itq.near_duplicate_vectors(frame(spark, rows)).collect()), key=str)


def planted(n, dim, seed, labels=3):
    """Centres, each with a few vectors at cosines of 0.975 to 0.999, and a
    chain whose ends are not linked directly; ids and order are mixed."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)

    def near(x, cosine):
        away = rng.normal(size=dim)
        away = unit(away - away @ x * x)
        return cosine * x + np.sqrt(1 - cosine**2) * away

    vectors = []
    while len(vectors) < n:
        x, label = unit(rng.normal(size=dim)), int(rng.integers(labels))
        vectors.append((x, label))
        vectors += [(near(x, rng.uniform(0.975, 0.999)), label) for _ in range(rng.integers(0, 6))]
        if rng.random() < 0.2:
            for _ in range(5):
                x = near(unit(x), 0.985)
                vectors.append((x, label))
    ids = rng.permutation(len(vectors) * 3)[: len(vectors)]
    return [(int(i), (v * rng.uniform(0.1, 50)).astype(np.float32).tolist(), label) for i, (v, label) in zip(ids, vectors)]


@pytest.mark.parametrize("dim", [64, 512])
def test_recall_of_planted_links(spark, dim):
    """Every link that is returned is one; nearly all are found.  Directly
    linked vectors are few per centre, so a lost one shows in n_links."""
    rows = planted(700, dim, dim)
    want, found = {r[0]: r[1:] for r in brute.op6(rows)}, {r[0]: r[1:] for r in got(spark, rows)}
    links, all_links = sum(r[0] for r in found.values()), sum(r[0] for r in want.values())
    assert all_links > 1000 and all(found[i][0] <= want[i][0] for i in want)
    assert links >= 0.99 * all_links
    if links == all_links:
        assert found == want


def test_odd_vectors(spark):
    """Null, zero, non-finite and ragged vectors, null labels, repeated rows,
    equal vectors under several ids, repeated and null ids, clashing columns."""
    nan, inf = float("nan"), float("inf")
    rows = planted(60, 64, 1)
    good, label = rows[0][1], rows[0][2]
    odd = [None, [0.0] * 64, [nan] + good[1:], [inf] + good[1:], good[:-1] + [None], [], good[:32], good[:32]]
    rows += [(10_000 + k, v, label) for k, v in enumerate(odd)]
    rows += [(11_000, good, None), (11_001, good, label), (11_002, good, label), (11_003, [2 * x for x in good], label), (11_004, good, label + 1)]
    assert got(spark, rows) == sorted(brute.op6(rows), key=str)
    # rows of one id are vectors of their own; without an id nothing is linked
    extra = [(11_001, good, label), (None, good, label), (None, None, None)]
    more = {r[0]: r[1:] for r in got(spark, rows + extra)}
    base = {r[0]: r[1:] for r in got(spark, rows)}
    assert more[11_001][0] == base[11_001][0] + 1 and more[None] == (0, None, False)
    assert len(got(spark, rows + extra)) == len(rows) + 3


def test_no_and_few_vectors(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, 1)]) == [(1, 0, 1, True)]
    assert got(spark, [(2, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (3, [0.0, 1.0], 1)]) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_a_large_near_group(spark):
    """Hundreds of vectors, all linked with each other."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=64)
    rows = [(i, (x + rng.normal(size=64) * 0.05).tolist(), 1) for i in range(400)] + [(1000 + i, rng.normal(size=64).tolist(), 1) for i in range(50)]
    assert got(spark, rows) == sorted(brute.op6([(i, np.float32(v).tolist(), label) for i, v, label in rows]), key=str)

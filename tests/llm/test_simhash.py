from __future__ import annotations

import random

import numpy as np
import pytest

from flowtally.llm import simhash
from flowtally.llm.components import connected_components
from tests.llm import brute
from tests.llm.conftest import EDGE_TEXTS

ANY = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)


def rows(df):
    return sorted(map(tuple, df.collect()), key=ANY)


def check(make_docs, pairs):
    assert rows(simhash.near_duplicate_groups(make_docs(pairs))) == sorted(brute.op1(pairs), key=ANY)


def test_edges(make_docs):
    check(make_docs, EDGE_TEXTS)


def test_near_copies(make_docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    pairs = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([5, 40, 400]))]
        for c in range(4):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(len(w))] = "edit"
            pairs.append((len(pairs), " ".join(w)))
    rng.shuffle(pairs)
    check(make_docs, pairs)


def test_golay_keys_meet():
    """Nearest codeword and four-ball as the module promises."""
    golay, rng = simhash.GolayKeys(), np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 3000)
    assert golay.count.max() == 6 and (golay.count >= 1).all()
    one = x ^ (1 << rng.integers(0, 23, len(x)))
    two = one ^ (1 << rng.integers(0, 23, len(x)))
    near = golay.nearest(x)
    ball = lambda v: [set(i[r == k].tolist()) for r, i in [golay.ball(v)] for k in range(len(v))]
    bx, b1, b2 = ball(x), ball(one), ball(two)
    assert all(n in b for n, b in zip(near.tolist(), b1))
    assert all(a & b for a, b in zip(bx, b2))


def test_every_link_up_to_four_bits_is_found(spark):
    rng = random.Random(5)
    seen = set()
    for _ in range(150):
        base = rng.getrandbits(64)
        for _ in range(6):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            seen.add(x)
    seen |= {0, 2**64 - 1, 1, 15, 31}
    signed = [x - (1 << 64) if x >> 63 else x for x in seen]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    got = {tuple(r) for r in simhash.simhash_links(df).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert got == want
    with pytest.raises(ValueError):
        simhash.simhash_links(df, 5)


def test_empty_and_clashing_columns(spark, make_docs):
    empty = make_docs([])
    assert simhash.near_duplicate_groups(empty).collect() == []
    extra = make_docs([(1, "a b c d e"), (2, "a b c d e")]).selectExpr("*", "1 AS fp", "2 AS key", "3 AS component_id")
    assert {r.component_id for r in simhash.near_duplicate_groups(extra).collect()} == {1}


def test_drop_near_duplicates(make_docs):
    got = simhash.drop_near_duplicates(make_docs(EDGE_TEXTS))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    low = {c for _, _, c in brute.op1(EDGE_TEXTS) if c is not None}
    assert sorted(r.doc_id for r in got.where("doc_id is not null").collect()) == sorted(low)
    assert got.where("doc_id is null").count() == 2


def test_repeated_ids_of_different_texts(make_docs):
    """The row that stays belongs to the group, whatever its id does elsewhere."""
    words = lambda w: " ".join(f"{w}{i}" for i in range(40))
    a, b, c = words("a"), words("b"), words("c")
    got = lambda pairs: rows(simhash.drop_near_duplicates(make_docs(pairs)).select("doc_id", "text"))
    assert got([(3, a), (7, a), (7, b)]) == [(3, a), (7, b)]
    assert got([(7, c), (7, b), (7, a), (8, c), (7, a)]) == [(7, a), (7, b), (7, c)]
    assert got([(5, a.upper()), (5, a), (6, a), (5, a)]) == [(5, a.upper())]  # one fingerprint, first in byte order


def test_components_match_union_find(spark):
    rng = random.Random(9)
    for n, m in ((1, 0), (30, 20), (200, 180), (300, 900)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(500, 560)]
        edges += [(700, 700 + i) for i in range(1, 200)] + [(None, 3), (4, 4)]
        nodes = {x for e in edges for x in e if None not in e and e[0] != e[1]}
        want = brute.components(nodes, [e for e in edges if None not in e and e[0] != e[1]])
        got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []

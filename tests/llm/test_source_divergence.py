"""Term shares of sources against plain Python, and the pointer sort."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from flowtally.llm import source_divergence as sd
from tests.llm.brute import LOWER
from tests.llm.conftest import EDGE_TEXTS

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, held int, value int"


def brute(rows, min_docs=3, top=200):
    """rows: (text, lang, source)."""
    docs = [(TERM.findall((t or "").translate(LOWER)), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        df, groups = Counter(), {}
        for words, at, source in docs:
            if at == lang:
                df.update(set(words))
                groups.setdefault(source, Counter()).update(words)
        kept = [t for t, n in df.items() if n >= min_docs]
        total = Counter()
        for c in groups.values():
            total.update(c)
        n = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        share = lambda c, of: 1 + 10**9 * (c + 1) // of
        p = {s: {t: share(c[t], n[s] + len(kept)) for t in kept} for s, c in groups.items()}
        q = {t: share(total[t], sum(n.values()) + len(kept)) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            term = [(t, gap(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, k) for k, (t, v) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def got(spark, rows, parts=3, **args):
    df = spark.createDataFrame([(k, *r, 1, "x", 2, 3) for k, r in enumerate(rows)], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in sd.source_divergence(df, **args).collect())


@pytest.mark.parametrize("shard_bytes", [16 << 20, 400])
def test_random(spark, shard_bytes):
    """A hot source, small vocabularies, long words with shared beginnings."""
    rng = random.Random(1)
    words = ["a", "B", "abcdefgh", "abcdefghi", "ABCDEFGHijklmnop", "abcdefghijklmnopq", "été", "日本", "abc1def", "x_y"] + [f"w{'q' * k}" for k in range(30)]
    rows = []
    for _ in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40])))
        rows.append((text, rng.choice(["en", "en", "fr"]), rng.choice(["hot", "hot", "hot", "s1", "s2", "s3", "s4"])))
    assert got(spark, rows, shard_bytes=shard_bytes) == brute(rows)
    assert got(spark, rows, shard_bytes=shard_bytes, min_docs=1, top_terms=3) == brute(rows, 1, 3)


def test_edges(spark):
    """Nulls count as empty, repeated rows count again, a language without
    kept terms has pairs of value 0, extra columns are never read."""
    rows = [(t, "en", f"s{k % 3}") for k, (_, t) in enumerate(EDGE_TEXTS * 2)]
    rows += [(t, None, None) for _, t in EDGE_TEXTS] + [("one two", "", "s"), (None, "de", "a"), ("", "de", "b"), ("ja nein", "de", None)]
    rows += [("the " * 50_000 + "end", "en", "s0")] * 3
    assert got(spark, rows) == brute(rows)
    assert [r for r in got(spark, rows) if r[0] == "de" and r[4]] == []
    assert got(spark, []) == []
    assert got(spark, [(None, None, None)]) == []


def test_many_sources(spark):
    """A source without kept terms still takes part in every pair."""
    rng = random.Random(3)
    rows = [(f"common {rng.choice('abcdef')} {rng.choice('xyz')}", "en", f"s{rng.randrange(40)}") for _ in range(200)]
    rows += [("lonely", "en", "only"), ("", "en", "empty")]
    assert got(spark, rows) == brute(rows)


def test_other_columns(spark):
    df = spark.createDataFrame([("A b", "l", "s"), ("a", "l", "t"), ("a", "l", "t")], "body string, tongue string, site string")
    out = sd.source_divergence(df, text_col="body", lang_col="tongue", source_col="site").collect()
    assert sorted(tuple(r) for r in out) == brute([("A b", "l", "s"), ("a", "l", "t"), ("a", "l", "t")])


@pytest.mark.parametrize("slice_size", [1 << 17, 300])
def test_pointer_sort(monkeypatch, slice_size):
    monkeypatch.setattr(sd, "SLICE", slice_size)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abé") * rng.choice([1, 2, 7, 8, 9, 16, 17, 40]) + rng.choice(["", "z", "Zq"]) for _ in range(rng.randrange(60))).encode() for _ in range(200)]
    edges = np.cumsum([0, *map(len, texts)])
    tokens = sd.Tokens(np.frombuffer(b"".join(texts), np.uint8), edges)
    want = sorted(w.encode() for t in texts for w in TERM.findall(t.decode().translate(LOWER)))
    pointers, new = tokens.sort()
    found = [w.encode() for w in tokens.bytes_of(pointers).to_pylist()]
    assert found == want
    assert [k for k in range(len(want)) if not k or want[k] != want[k - 1]] == np.flatnonzero(new).tolist()

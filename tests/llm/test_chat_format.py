"""Prefix trees of conversations against plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowtally.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, node string, tree int, conv string, start long, nth int"
PROBE = "</s>[INST] ok [/INST]"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA).repartition(parts)


def conversations(rows):
    """id -> [(role, text)], in order."""
    by_id = {}
    for i, turn, role, text in rows:
        by_id.setdefault(i, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {i: [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for i, turns in by_id.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = []
    for i, turns in conversations(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(cf.format_turn(r, t)[0]) for r, t in turns)
        out.append((i, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars))
    return sorted(out, key=str)


def check(spark, rows):
    """Digests, and the whole packed layout."""
    chats = cf.format_conversations(table(spark, rows))
    assert sorted((tuple(r) for r in cf.conversation_digests(chats).collect()), key=str) == brute(rows)
    packed, want = chats.packed.collect(), conversations(rows)
    # Every distinct prefix once.
    prefixes = {tuple(turns[:k]) for turns in want.values() for k in range(1, len(turns) + 1)}
    assert len(packed) == len({r.node for r in packed}) == len(prefixes)
    trees, by_node = {}, {r.node: r for r in packed}
    for r in sorted(packed, key=lambda r: (r.tree, r.start)):
        text = trees.setdefault(r.tree, "")
        assert r.start == len(text) and r.end == r.start + len(r.text)  # no gap, no overlap
        trees[r.tree] = text + r.text
    assert sum(map(len, trees.values())) == sum(len(cf.format_turn(*p[-1])[0]) for p in prefixes)
    parents, subtree = {}, {}
    for i, turns in want.items():
        path = [r.node for r in sorted(chats_paths(chats)[i], key=lambda r: r.nth)]
        assert len(path) == len(turns)
        position = 0
        for k, node in enumerate(path):
            r = by_node[node]
            assert r.depth == k + 1 and r.position == position and r.text == cf.format_turn(*turns[k])[0]
            # What a node's last code point sees is the conversation so far.
            ends = [e for _, e in r.attends]
            assert all(a < b for a, b in r.attends) and all(e < b for e, (b, _) in zip(ends, r.attends[1:]))
            seen = "".join(trees[r.tree][a:b] for a, b in r.attends) + trees[r.tree][r.run_start : r.end]
            assert seen == "".join(cf.format_turn(*t)[0] for t in turns[: k + 1])
            position += len(r.text)
            parents[node] = path[k - 1] if k else None
            for ancestor in path[: k + 1]:
                subtree.setdefault(ancestor, set()).add(node)
    # Depth-first: a subtree is one interval that its root begins.
    for node, below in subtree.items():
        assert by_node[node].start == min(by_node[n].start for n in below)
        assert max(by_node[n].end for n in below) - by_node[node].start == sum(len(by_node[n].text) for n in below)
    return packed


def chats_paths(chats, kept={}):  # noqa: B006
    if kept.get("of") is not chats:
        kept.clear()
        by_id = {}
        for r in chats.paths.collect():
            by_id.setdefault(r.conv_id, []).append(r)
        kept.update(of=chats, by_id=by_id)
    return kept["by_id"]


def test_edges(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "hi"), (2, 1, "assistant", None), (3, None, "user", "no turn"), (3, 0, "user", "x"),
        (None, 0, "user", "no id"), (None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (4, 0, "user", "tie"), (4, 0, "assistant", "tie"), (4, 0, "user", "tie"),
        (5, 0, "user", PROBE), (5, 1, "assistant", PROBE), (6, 0, "we[/INST]ird</s>\\", "a\\b[INST"), (6, 1, "assistant", "]</s>" * 20_000 + "é\U0001f600"),
        (7, -3, "system", "first"), (7, 10, "assistant", "last"), (2**62, 0, "assistant", "\\"), (8, 0, "user", "\x00\r\n"), (9, 0, "user", "hi"),
    ]
    check(spark, rows)


def test_shared_turns(spark):
    """A hot first turn, copies, conversations that begin another, and
    branches at every depth."""
    rng = random.Random(5)
    rows = []
    for i in range(150):
        turns = [("system", "common" if rng.random() < 0.7 else f"s{i}")]
        while rng.random() < 0.75:
            turns.append((rng.choice(["user", "assistant"]), rng.choice("ab") * rng.choice([1, 1, 30])))
        rows += [(i, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(1000 + c, k, "user", f"copy {k}") for c in range(40) for k in range(5)]
    rows += [(2000 + c, k, "user", f"long {k if k < 90 else (c, k)}") for c in range(4) for k in range(100)]
    packed = check(spark, rows)
    assert any(len(r.attends) > 1 for r in packed)


def test_no_rows(spark):
    assert check(spark, []) == []


def test_string_ids_and_names(spark):
    df = spark.createDataFrame([("a", 1, "user", "x"), ("a", 2, "assistant", "y"), ("", 1, "user", "x"), (None, 1, "user", "x")], "k string, n int, who string, body string")
    got = cf.conversation_digests(cf.format_conversations(df, "k", "n", "who", "body")).collect()
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in got} == {("a", 2, 1), ("", 1, 0), (None, 1, 0)}


CONTROL_PIECES = st.lists(st.sampled_from([*cf.CONTROL, "\\", "<", "[", "/", "s>", "INST]", "|", "é", "x"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(CONTROL_PIECES, CONTROL_PIECES)
def test_escapes(role, text):
    assert cf.unescape(cf.escape(text)) == text
    assert not any(c in cf.escape(text) for c in cf.CONTROL)
    turn, low, high = cf.format_turn(role, text)
    assert cf.parse_turn(turn) == (role, text) and low == high
    turn, low, high = cf.format_turn("assistant", text)
    assert cf.unescape(turn[low:high]) == text


@pytest.mark.parametrize("parts", [1, 7])
def test_layout_over_partitions(spark, parts):
    """One tree over several range partitions: places do not depend on them."""
    rows = [(i, k, "user", "same" if k < 2 else f"{i % 9} {k}" if k < 4 else f"{i} {k}") for i in range(120) for k in range(6)]
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])

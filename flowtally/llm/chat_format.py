"""Conversations formatted for training as prefix trees.

Conversations that begin with the same turns share them: every distinct prefix
is one node, emitted once.  A tree (all conversations of one first turn) is one
packed sequence of code points in depth-first order.  A node's row says where
it stands in that sequence, the position ids of its code points (their place in
the conversation, as if it were alone), and which intervals of the sequence
they attend to: those of the ancestors, besides the node's own run.

Turns are chained into node ids by one streaming pass per conversation, so that
no conversation is held whole.  Depth-first order is the order of the
conversations' node sequences, cut where no other conversation shares the node;
it is laid out by a range partitioning, so a first turn that a third of all
conversations share is split over tasks.  Each conversation owns what it does
not share with its predecessor, and running sums per partition and over the
partitions of a tree give every run its place.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.llm.common import write_table

# The control strings of public chat templates.  The first three
# mark turns here; all are escaped inside roles and texts.
TURN, BODY, END = "[INST]", "[/INST]", "</s>"
CONTROL = (TURN, BODY, END, "<s>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
TRAINED = "assistant"

# A control string is broken after its first character; an escape is doubled.
_BREAK = re.compile(re.escape(ESCAPE) + "|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_MEND = re.compile(re.escape(ESCAPE) + "(" + re.escape(ESCAPE) + "?)")


def escape(text: str) -> str:
    """Without control strings; ``unescape`` gives the text back."""
    return _BREAK.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    return _MEND.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and its trained part (an assistant's text)."""
    head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
    end = len(head) + len(body)
    return f"{head}{body}{END}", len(head) if role == TRAINED else end, end


def parse_turn(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    at = turn.index(BODY, len(TURN))
    return unescape(turn[len(TURN) : at]), unescape(turn[at + len(BODY) : -len(END)])


class Chats(NamedTuple):
    """``packed(tree, start, end, position, depth, node, text, loss_start,
    loss_end, run_start, attends)``: one row per node, in depth-first order;
    ``start`` to ``end`` is its place in the tree's sequence, ``position`` the
    position id of its first code point, ``loss_start`` to ``loss_end`` the
    trained part of ``text``.  Its code points attend to ``attends`` (disjoint
    (start, end), ascending) and, causally, to the sequence from ``run_start``
    on.  ``paths(conv_id, conv, nth, node)``: the nodes of each conversation."""

    packed: DataFrame
    paths: DataFrame


TURNS = "tree string, node string, nth long, position long, length long, text string, loss_start long, loss_end long, last boolean"


def _chain(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, conv, turn, role, text)`` formatted and chained: a
    node's id is the digest of its parent's id and its own turn.  A task holds
    one turn of a conversation at a time."""
    names = ["conv_id", "conv", *(f.split()[0] for f in TURNS.split(", "))]

    def run(batches):
        conv, held = None, None
        for batch in batches:
            out = []
            for conv_id, key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "conv", "role", "text"))):
                if key != conv:
                    conv, tree, node, nth, position = key, None, "", 0, 0
                elif held:
                    held[-1] = False
                if held:
                    out.append(held)
                turn, loss_start, loss_end = format_turn(role, text)
                node = hashlib.blake2b(f"{node}{turn}".encode(), digest_size=16).hexdigest()
                tree, nth = tree or node, nth + 1
                held = [conv_id, key, tree, node, nth, position, len(turn), turn, loss_start, loss_end, True]
                position += len(turn)
            yield pack(out, batch)
            last = batch
        if held:
            yield pack([held], last)

    def pack(out, batch):
        kinds = [batch.schema.field("conv_id").type, *[pa.string()] * 3, *[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), kinds)], names)

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, conv string, {TURNS}")


def _shared_paths(turns: DataFrame) -> DataFrame:
    """One row per distinct conversation: ``nodes`` that other distinct
    conversations hold too, with their ``ends`` along the conversation, and its
    length in ``chars``.  A node's descendants are shared no more than it, so
    long conversations cost only what they share."""
    kept = turns.where("last").groupBy("node").agg(F.min("conv").alias("conv")).select("conv")
    kept = write_table(turns.select("conv", "tree", "node", "nth", "position", "length").join(kept, "conv"), "chat-turns")
    shared = write_table(kept.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.lit(True).alias("shared")), "chat-shared")
    path = F.array_sort(F.collect_list(F.when(F.col("shared"), F.struct("nth", "node", (F.col("position") + F.col("length")).alias("end")))))
    rows = kept.join(shared, "node", "left").groupBy("conv").agg(F.min("tree").alias("tree"), F.sum("length").alias("chars"), path.alias("path"))
    return rows.select("conv", "tree", "chars", F.col("path.node").alias("nodes"), F.col("path.end").alias("ends"))


def _place(ends: Column, k: Column) -> Column:
    """Where node number ``k`` ends along the conversation (0: before all)."""
    return F.coalesce(F.try_element_at(ends, F.nullif(k, F.lit(0))), F.lit(0)).cast("long")


def _layout(paths: DataFrame) -> DataFrame:
    """``(conv, tree, nodes, ends, depth, branch, start)``: a conversation
    shares its first ``depth`` nodes, up to position ``branch``, with one
    before it; the rest, its run, begins at ``start`` of the tree's sequence."""
    order = ("tree", "nodes", "conv")
    rows = paths.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    rows = write_table(rows.withColumn("part", F.shiftright("seq", 33)), "chat-order")
    # The predecessor of a partition's first conversation of a tree is the last
    # one of an earlier partition; a tree has one row per partition there.
    of_tree = Window.partitionBy("tree").orderBy("part")
    edges = rows.groupBy("part", "tree").agg(F.max_by("nodes", "seq").alias("tail")).select("part", "tree", F.lag("tail").over(of_tree).alias("earlier"))
    here = Window.partitionBy("part", "tree").orderBy("seq")
    before = F.coalesce(F.lag("nodes").over(here), F.col("earlier"))
    runs = rows.join(edges, ["part", "tree"]).withColumn("depth", F.coalesce(F.size(F.array_intersect("nodes", before)), F.lit(0)))
    runs = runs.withColumn("branch", _place(F.col("ends"), F.col("depth"))).withColumn("new", F.col("chars") - F.col("branch"))
    runs = write_table(runs.withColumn("at", F.coalesce(F.sum("new").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "chat-runs")
    so_far = F.coalesce(F.sum("n").over(of_tree.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.groupBy("part", "tree").agg(F.sum("new").alias("n")).select("part", "tree", so_far.alias("offset"))
    return runs.join(offsets, ["part", "tree"]).select("conv", "tree", "nodes", "ends", "depth", "branch", (F.col("at") + F.col("offset")).alias("start"))


def _attention(runs: DataFrame) -> DataFrame:
    """``(conv, attends)``: the sequence's intervals that hold the ancestors
    of a conversation's run."""
    begin = _place(F.col("ends"), F.col("k"))
    nodes = runs.select("conv", "ends", "depth", "branch", "start", F.posexplode("nodes").alias("k", "node"))
    nodes = nodes.withColumn("from", F.col("start") + begin - F.col("branch")).withColumn("to", F.col("from") + F.element_at("ends", F.col("k") + 1) - begin)
    owned = nodes.where(F.col("k") >= F.col("depth")).select("node", "from", "to")
    found = nodes.where(F.col("k") < F.col("depth")).select("conv", "node").join(owned, "node")
    # Neighbours in the sequence merge.
    path = Window.partitionBy("conv").orderBy("from")
    found = found.withColumn("gap", (~F.col("from").eqNullSafe(F.lag("to").over(path))).cast("int")).withColumn("island", F.sum("gap").over(path))
    islands = found.groupBy("conv", "island").agg(F.min("from").alias("start"), F.max("to").alias("end"))
    return islands.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("attends"))


def format_conversations(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Chats:
    """All conversations as packed prefix trees and the paths through them.

    A conversation's rows go by turn, ties by role and text; repeated rows are
    turns of their own; null turns come first; null roles and texts are empty;
    rows with a null id are one conversation.  Other columns are never read;
    no rows give empty tables.  One conversation's node ids, like its digest,
    come from one task, which streams its turns.
    """
    named = [F.col(f"`{c}`") for c in (id_col, turn_col, role_col, text_col)]
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in named[2:])
    key = F.coalesce(F.concat(F.lit("="), named[0].cast("string")), F.lit(""))
    rows = conversations.select(named[0].alias("conv_id"), key.alias("conv"), named[1].alias("turn"), role.alias("role"), text.alias("text"))
    turns = write_table(_chain(rows), "chat-nodes")
    paths = write_table(_shared_paths(turns), "chat-paths")
    runs = write_table(_layout(paths.where(F.size("nodes") > 0)), "chat-layout")
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    branching = runs.join(_attention(runs), "conv", "left").select("conv", "depth", "branch", "start", F.coalesce("attends", nothing).alias("attends"))
    alone = paths.where(F.size("nodes") == 0).select("conv", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("branch"), F.lit(0).cast("long").alias("start"), nothing.alias("attends"))
    owned = turns.join(branching.unionByName(alone).withColumnRenamed("start", "run_start"), "conv").where(F.col("nth") > F.col("depth"))
    start = F.col("run_start") + F.col("position") - F.col("branch")
    packed = owned.select(
        "tree", start.alias("start"), (start + F.col("length")).alias("end"), "position", F.col("nth").alias("depth"), "node", "text",
        "loss_start", "loss_end", "run_start", "attends",
    )
    packed = write_table(packed.repartitionByRange("tree", "start").sortWithinPartitions("tree", "start"), "chat-packed")
    return Chats(packed, turns.select("conv_id", "conv", "nth", "node"))


def conversation_digests(chats: Chats) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars)``, read back from the packed rows: roles and texts, and
    what the loss mask covers, without escapes.  A conversation is streamed."""
    read = chats.paths.join(chats.packed.select("node", "text", "loss_start", "loss_end"), "node")
    schema = f"conv_id {read.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        conv, state = None, None

        def close(batch):
            conv_id, n, turns, trained, loss, chars = state
            row = [conv_id, n, turns.hexdigest(), trained, loss.hexdigest(), chars]
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for conv_id, key, turn, low, high in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "conv", "text", "loss_start", "loss_end"))):
                if key != conv:
                    if state:
                        yield close(batch)
                    conv, state = key, [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(turn)
                trained = unescape(turn[low:high])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(trained)
                state[4].update(trained.encode())
                state[5] += len(turn)
            last = batch
        if state:
            yield close(last)

    return read.repartition("conv").sortWithinPartitions("conv", "nth").drop("node").mapInArrow(run, schema)

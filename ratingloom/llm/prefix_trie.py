"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt in order of their id; a shard is some consecutive ones, at most about ``TURNS`` turns or ``MEMBERS``
conversations. In a shard every (position, turn) has the bitset of the conversations that hold it. From the root, the
bitset of all, the trie is walked depth first: intersected with the postings of the next position, a node's bitset yields
its children, population counts their members, and the members that have no further turn are the node's end list.

Shards meet by the digest of a path, in a fixed number of shuffles however deep the trie is. What adds up is summed: members,
and for subtrees the text of every member below a node. What must count once, each distinct node below, is counted in the
shard that holds the node's smallest member; all ancestors of a node are in that shard too, so its sums by subtree (ranges
of the preorder) add up as well. End lists stay lists by shard, in order of the ids, and are never put together in a row.

Turns travel as 128-bit digests of role and text with the text's length. Nulls and odd rows: null role and text are empty; a
null turn number comes first; equal turn numbers are ordered by role, then text, and repeated rows are turns of their own; a
null conversation id names no conversation and is left out; a member without turns belongs to the root alone; without any
member there is no node. One conversation must fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ratingloom.llm.store import cut, on_workers

TURNS = 60_000
MEMBERS = 4_096
# ids of an end list that travel in one row
PIECE = 512

_NODE = (
    "shard long, pre int, parent int, size int, path binary, depth int, chars long, conv_id long, n_convs long, "
    "n_ends long, below long, ends array<long>"
)


@dataclass
class PrefixTrie:
    """``nodes``: (path, conv_id, depth, parent_conv_id, n_convs, n_ends, n_children, n_leaves, saved), one row per node.
    ``ends``: (path, ids), the members that end at a node in ascending pieces of at most ``PIECE``."""

    nodes: DataFrame
    ends: DataFrame


def turn_marks(
    conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, position, mark, chars): the turns of each conversation, counted from 1."""
    empty = F.lit("")
    rows = conversations.select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), empty).alias("role"),
        F.coalesce(F.col(text), empty).alias("text"),
    ).where("conv_id IS NOT NULL")
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    spelled = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select(
        "conv_id",
        F.row_number().over(in_order).alias("position"),
        F.unhex(F.md5(spelled.cast("binary"))).alias("mark"),
        F.char_length("text").cast("long").alias("chars"),
    )


def walk(ids: list[int], marks: list[list[bytes]], chars: list[list[int]]) -> dict[str, list]:
    """Columns of the nodes of one shard in preorder, subtree sums not yet made; ``ids`` ascend."""
    postings: dict[tuple[int, bytes], int] = {}
    ending: dict[int, int] = {}
    for slot, turns in enumerate(marks):
        bit = 1 << slot
        for position, mark in enumerate(turns):
            postings[position, mark] = postings.get((position, mark), 0) | bit
        ending[len(turns)] = ending.get(len(turns), 0) | bit
    made: dict[str, list] = {c: [] for c in ("parent", "path", "depth", "chars", "conv_id", "n_convs", "ends")}
    stack = [((1 << len(ids)) - 1, 0, b"", 0, -1)]
    while stack:
        members, depth, path, length, parent = stack.pop()
        pre, done = len(made["path"]), members & ending.get(depth, 0)
        smallest = ids[(members & -members).bit_length() - 1]
        for name, value in zip(
            made, (parent, path, depth, length, smallest, members.bit_count(), _listed(done, ids)), strict=True
        ):
            made[name].append(value)
        rest, children = members ^ done, []
        while rest:
            slot = (rest & -rest).bit_length() - 1
            mark = marks[slot][depth]
            child = rest & postings[depth, mark]
            below = hashlib.blake2b(path + mark, digest_size=16).digest()
            children.append((child, depth + 1, below, chars[slot][depth], pre))
            rest ^= child
        stack.extend(reversed(children))
    return made


def _listed(members: int, ids: list[int]) -> list[int]:
    found = []
    while members:
        lowest = members & -members
        found.append(ids[lowest.bit_length() - 1])
        members ^= lowest
    return found


def _sizes(parent: np.ndarray) -> np.ndarray:
    """Nodes in each subtree, from the parents of a preorder."""
    size = np.ones(len(parent), np.int64)
    for node in range(len(parent) - 1, 0, -1):
        size[parent[node]] += size[node]
    return size


def _below(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each subtree, a range of the preorder."""
    sums = np.concatenate([[0], np.cumsum(values)])
    places = np.arange(len(values))
    return sums[places + size] - sums[places]


def _shard_nodes(conversations: list[tuple[int, list[bytes], list[int]]]) -> pa.RecordBatch:
    ids, marks, chars = (list(x) for x in zip(*conversations, strict=True))
    made = walk(ids, marks, chars)
    parent, members = np.array(made["parent"], np.int32), np.array(made["n_convs"], np.int64)
    size, length = _sizes(parent), np.array(made["chars"], np.int64)
    n = len(parent)
    return pa.record_batch(
        [
            pa.array(np.full(n, ids[0], np.int64)),
            pa.array(np.arange(n, dtype=np.int32)),
            pa.array(parent),
            pa.array(size.astype(np.int32)),
            pa.array(made["path"], pa.binary()),
            pa.array(made["depth"], pa.int32()),
            pa.array(length),
            pa.array(made["conv_id"], pa.int64()),
            pa.array(members),
            pa.array([len(e) for e in made["ends"]], pa.int64()),
            pa.array(_below(members * length, size)),
            pa.array(made["ends"], pa.list_(pa.int64())),
        ],
        [f.split()[0] for f in _NODE.split(", ")],
    )


def _shards(batches: Iterator[pa.RecordBatch], turns: int, members: int) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and position, a row without a mark opening each conversation."""
    held: list[tuple[int, list[bytes], list[int]]] = []
    seen = 0
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(3))
        for conv_id, mark, length in zip(*columns, strict=True):
            if mark is None:
                if held and (seen >= turns or len(held) >= members):
                    yield _shard_nodes(held)
                    held, seen = [], 0
                held.append((conv_id, [], []))
            else:
                held[-1][1].append(mark)
                held[-1][2].append(length)
                seen += 1
    if held:
        yield _shard_nodes(held)


def _owned(rows: pd.DataFrame) -> pd.DataFrame:
    """What one shard counts for each of its nodes: the distinct nodes whose smallest member it holds."""
    rows = rows.sort_values("pre")
    parent, size = rows["parent"].to_numpy(), rows["size"].to_numpy()
    own = rows["own"].to_numpy()
    children = np.zeros(len(rows), np.int64)
    np.add.at(children, parent[1:], own[1:].astype(np.int64))
    smallest = rows["smallest"].to_numpy()
    return pd.DataFrame(
        {
            "path": rows["path"],
            "depth": rows["depth"],
            "conv_id": smallest,
            "parent_conv_id": pd.arrays.IntegerArray(smallest[parent], parent < 0),
            "n_convs": rows["n_convs"],
            "n_ends": rows["n_ends"],
            "n_children": children,
            "n_leaves": _below((own & rows["leaf"].to_numpy()).astype(np.int64), size),
            "saved": rows["below"].to_numpy() - _below(np.where(own, rows["chars"].to_numpy(), 0), size),
        }
    )


def prefix_trie(marks: DataFrame, members: DataFrame, turns: int = TURNS, shard_members: int = MEMBERS) -> PrefixTrie:
    """The trie of ``marks``, rows (conv_id, position, mark, chars) with positions 1, 2, ... in every conversation;
    ``members`` (conv_id) names each conversation once, those without turns too."""
    on_workers(marks.sparkSession)
    opened = members.select(
        "conv_id", F.lit(0).alias("position"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("long").alias("chars")
    )
    rows = cut(opened.unionByName(marks.select("conv_id", "position", "mark", "chars")))
    dealt = rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "mark", "chars")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shards(batches, turns, shard_members)

    # stored, since shards are told by where the ranges were cut
    local = cut(dealt.mapInArrow(shards, _NODE))
    whole = local.groupBy("path").agg(
        F.min("conv_id").alias("smallest"), (F.sum("n_convs") == F.sum("n_ends")).alias("leaf")
    )
    known = local.drop("ends").join(whole.withColumnRenamed("path", "__path"), F.col("path") == F.col("__path"))
    marked = known.withColumn("own", F.col("conv_id") == F.col("smallest")).drop("__path", "conv_id")
    counted = marked.groupBy("shard").applyInPandas(
        _owned,
        "path binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_ends long, n_children long, "
        "n_leaves long, saved long",
    )
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_ends", "n_children", "n_leaves", "saved")]
    same = [F.max(c).alias(c) for c in ("depth", "conv_id", "parent_conv_id")]
    nodes = counted.groupBy("path").agg(*same, *sums)
    pieces = F.transform(
        F.sequence(F.lit(0), ((F.col("n_ends") - 1) / PIECE).cast("int")),
        lambda k: F.slice("ends", k * PIECE + 1, F.lit(PIECE)),
    )
    ends = local.where("n_ends > 0").select("path", F.explode(pieces).alias("ids"))
    return PrefixTrie(nodes, ends)


def conversation_trie(conversations: DataFrame, turns: int = TURNS, shard_members: int = MEMBERS) -> PrefixTrie:
    """The trie of a table (conv_id, turn, role, text)."""
    marks = cut(turn_marks(conversations))
    return prefix_trie(marks, marks.select("conv_id").distinct(), turns, shard_members)


def end_digests(ends: DataFrame) -> DataFrame:
    """(path, ends_sha256): digest of a node's whole end list, ids in decimal and joined by commas. Pieces stream through
    in order, so a list of any length is digested in bounded memory."""
    ordered = ends.withColumn("first", F.element_at("ids", 1)).repartition("path").sortWithinPartitions("path", "first")
    spelled = ordered.select("path", F.array_join(F.col("ids").cast("array<string>"), ",").alias("spelled"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, s) for b in batches for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        paths, digests = [], []
        for path, pieces in groupby(rows, lambda row: row[0]):
            digest = hashlib.sha256(next(pieces)[1].encode())
            for _, piece in pieces:
                digest.update(f",{piece}".encode())
            paths.append(path)
            digests.append(digest.hexdigest())
            if len(paths) == 10_000:
                yield pa.record_batch([pa.array(paths, pa.binary()), pa.array(digests)], ["path", "ends_sha256"])
                paths, digests = [], []
        yield pa.record_batch([pa.array(paths, pa.binary()), pa.array(digests, pa.string())], ["path", "ends_sha256"])

    return spelled.mapInArrow(digested, "path binary, ends_sha256 string")


def with_last_turn(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn, taken from the smallest member; the root has none. For tries made
    by ``conversation_trie``."""
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    empty = F.lit("")
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    placed = turns.withColumn("depth", F.row_number().over(in_order)).drop("turn")
    return nodes.join(placed, ["conv_id", "depth"], "left")

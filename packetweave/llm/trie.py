"""Prefix trie of conversations: which openings they share, and what sharing them saves.

Turns are numbered by a dictionary of their role and text, so a conversation is a
list of numbers.  Equal lists are one sequence with a count.  Sequences are dealt
out by ranges of their lists and cut into shards of at most ``SHARD_TURNS`` turns
(or one sequence).  Each shard puts its sequences into a ternary search tree, median
first, which keeps the trees of siblings balanced, and walks it without recursion.

A node of a shard is whole unless a neighbour shares its prefix, which the common prefixes
at the shard's two ends tell.  Counts of such boundary nodes are made to add up
(a sibling or saving that the shard before has counted is left out), so one grouped
sum over their prefixes completes them.

Turns are in order of ``turn``, null first, then of the digest of role and text.
Null roles and texts count as empty.  Rows without a conversation id belong to no
conversation.  Repeated rows are turns of their own.  Conversations without turns
are members of the root.  Long texts count by their length only; a
conversation's numbers, 16 bytes a turn, must fit into a task.  An empty table has no nodes.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave.llm.ranks import ranked
from packetweave.storage import materialize

SHARD_TURNS = 1 << 16
# Conversation ids whose decimal text is packed into one row.
PACKED_IDS = 1 << 16
# Fixed values of the rebuilt conversations: the head comes from the conversation that opens each hundred, h turns below HEADS.
HUNDRED, HEADS = 100, 6
NODE = (
    "shard bigint, depth bigint, turn_id bigint, first bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, "
    "end_class bigint, n_ends bigint, prefix binary, parent_prefix binary, parent_first bigint")


# From turns to numbered sequences.


def narrow_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars) of the turns that belong to a conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(told, 256)).alias("digest"), F.length(text).cast("long").alias("chars"))


def dictionary(turns: DataFrame) -> DataFrame:
    """(digest, turn_id), numbers ascending with the digests."""
    distinct = turns.groupBy("digest").agg(F.first("chars").alias("chars"))
    return distinct.select("digest").repartitionByRange("digest").sortWithinPartitions("digest").withColumn("turn_id", F.monotonically_increasing_id())


def numbered(turns: DataFrame, known: DataFrame) -> DataFrame:
    """(conv_id, ids, chars), one row per conversation."""
    listed = turns.join(known, "digest").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "turn_id", "chars"))).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: t["turn_id"]).alias("ids"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def with_heads(own: DataFrame) -> DataFrame:
    """Each conversation after the first h turns of the one that opens its hundred; its own first h turns go."""
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    none = F.array().cast("array<bigint>")
    heads = own.filter(F.col("conv_id") % HUNDRED == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, HEADS - 1).alias("head_ids"), F.slice("chars", 1, HEADS - 1).alias("head_chars"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    joined = own.withColumn("base", base).withColumn("h", h).join(heads, "base", "left")
    part = lambda head, rest: F.concat(F.slice(F.coalesce(head, none), F.lit(1), F.col("h")), F.slice(rest, F.col("h") + 1, F.size(rest)))
    return joined.select("conv_id", part(F.col("head_ids"), F.col("ids")).alias("ids"), part(F.col("head_chars"), F.col("chars")).alias("chars"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, chars) of the rebuilt conversations."""
    turns = materialize(narrow_turns(conversations), "trie-turns")
    known = materialize(dictionary(turns), "trie-dictionary")
    return with_heads(materialize(numbered(turns, known), "trie-own"))


# One shard.


class SearchTree:
    """A ternary search tree over lists of numbers; node 0 stands for the empty list.

    Per node: its number, the siblings below and above it, the first of its children,
    the members that start with it, their smallest id, and the sequence that ends there.
    """

    def __init__(self) -> None:
        self.sign, self.low, self.high, self.child = [-1], [-1], [-1], [-1]
        self.chars, self.members, self.first = [0], [0], [None]
        self.end_class, self.ends = [None], [0]

    def _new(self, sign: int, chars: int) -> int:
        for held, value in ((self.sign, sign), (self.low, -1), (self.high, -1), (self.child, -1), (self.chars, chars), (self.members, 0), (self.first, None), (self.end_class, None), (self.ends, 0)):
            held.append(value)
        return len(self.sign) - 1

    def _down(self, node: int, sign: int, chars: int) -> int:
        """The child of ``node`` with this number, made if it is not there."""
        at = self.child[node]
        if at < 0:
            self.child[node] = at = self._new(sign, chars)
            return at
        while self.sign[at] != sign:
            side = self.low if sign < self.sign[at] else self.high
            if side[at] < 0:
                side[at] = at = self._new(sign, chars)
                return at
            at = side[at]
        return at

    def add(self, ids: list[int], chars: list[int], count: int, first: int) -> None:
        node = 0
        self._count(node, count, first)
        for sign, size in zip(ids, chars, strict=True):
            node = self._down(node, sign, size)
            self._count(node, count, first)
        self.end_class[node], self.ends[node] = first, count

    def _count(self, node: int, count: int, first: int) -> None:
        self.members[node] += count
        known = self.first[node]
        if known is None or first < known:
            self.first[node] = first

    def path(self, ids: list[int]) -> list[int]:
        """Nodes from the empty list along these numbers, as far as they go."""
        found = [0]
        for sign in ids:
            at = self.child[found[-1]]
            while at >= 0 and self.sign[at] != sign:
                at = self.low[at] if sign < self.sign[at] else self.high[at]
            if at < 0:
                break
            found.append(at)
        return found

    def children(self, node: int) -> Iterator[int]:
        waiting, at = [], self.child[node]
        while waiting or at >= 0:
            while at >= 0:
                waiting.append(at)
                at = self.low[at]
            at = waiting.pop()
            yield at
            at = self.high[at]


def median_first(count: int) -> Iterator[int]:
    """0 to count - 1, each middle before what lies on either side of it."""
    waiting = [(0, count)]
    while waiting:
        low, high = waiting.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += [(middle + 1, high), (low, middle)]


def prefix_keys(ids: list[int], depth: int) -> list[bytes]:
    """Digests of the first 0 to ``depth`` numbers."""
    running = hashlib.sha256()
    keys = [running.digest()]
    for sign in ids[:depth]:
        running.update(sign.to_bytes(8, "big"))
        keys.append(running.digest())
    return keys


def shard_nodes(shard: int, sequences: list[tuple[list[int], list[int], int, int]], left: int, right: int) -> list[tuple]:
    """Rows of NODE from sorted sequences (ids, chars, count, first).

    ``left`` and ``right`` are the lengths of the prefix shared with the sequence before
    and after the shard, -1 where there is none.  Nodes up to there are open:
    they carry their prefix and hold this shard's part of the sums.
    """
    tree = SearchTree()
    for place in median_first(len(sequences)):
        tree.add(*sequences[place])
    size = len(tree.sign)
    prefix: list[bytes | None] = [None] * size
    before, after = [False] * size, [False] * size
    for ids, depth, mark in ((sequences[0][0], left, before), (sequences[-1][0], right, after)):
        if depth >= 0:
            for node, key in zip(tree.path(ids[:depth]), prefix_keys(ids, depth), strict=True):
                prefix[node], mark[node] = key, True
    order, parents, depths = [], [-1] * size, [0] * size
    waiting = [0]
    while waiting:
        node = waiting.pop()
        order.append(node)
        for child in tree.children(node):
            parents[child], depths[child] = node, depths[node] + 1
            waiting.append(child)
    children, leaves = [0] * size, [0] * size
    saved = [(tree.members[i] - (not before[i])) * tree.chars[i] for i in range(size)]
    for node in reversed(order):
        if tree.child[node] < 0 and not after[node]:
            leaves[node] = 1
        above = parents[node]
        if above >= 0:
            children[above] += not before[node]
            leaves[above] += leaves[node]
            saved[above] += saved[node]
    rows = []
    for node in order:
        above = parents[node]
        open_above = above >= 0 and prefix[above] is not None
        rows.append((
            shard, depths[node], tree.sign[node] if node else None, tree.first[node], tree.members[node], children[node], leaves[node], saved[node],
            tree.end_class[node], tree.ends[node], prefix[node], prefix[above] if open_above else None,
            None if above < 0 or open_above else tree.first[above]))
    return rows


# All shards.


def in_shards(classes: DataFrame, shard_turns: int) -> DataFrame:
    """Sorted sequences with the number of their shard; numbers ascend over the tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            marks = []
            for turns in pa.compute.list_value_length(batch.column(0)).to_pylist():
                if held and held + turns + 1 > shard_turns:
                    shard, held = shard + 1, 0
                held += turns + 1
                marks.append(shard)
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), *batch.columns], names=["shard", *batch.schema.names])

    ordered = classes.select("ids", "chars", "n", "first").repartitionByRange("ids").sortWithinPartitions("ids")
    return ordered.mapInArrow(cut, "shard bigint, ids array<bigint>, chars array<bigint>, n bigint, first bigint")


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard from rows (shard, left, right, ids, chars, n, first), shard after shard."""
    names = [part.split()[0] for part in NODE.split(", ")]
    kinds = {"prefix": pa.binary(), "parent_prefix": pa.binary()}
    now, ends, held = None, (-1, -1), []

    def done() -> pa.RecordBatch:
        rows = shard_nodes(now, held, *ends) if held else []
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(name, pa.int64())) for name, c in zip(names, columns, strict=True)], names=names)

    for batch in batches:
        for shard, left, right, ids, chars, count, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != now:
                yield done()
                now, ends, held = shard, (left, right), []
            held.append((ids, chars, count, first))
    yield done()


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two different lists."""
    return (F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True) - 1).cast("int")


def boundaries(cut: DataFrame) -> DataFrame:
    """(shard, left, right): lengths of the prefixes shared with the shards on either side, -1 where there is none."""
    ends = cut.groupBy("shard").agg(F.min("ids").alias("least"), F.max("ids").alias("most"))
    placed = materialize(ranked(ends, (), ("shard",), "trie-shard-order"), "trie-shards")
    after = placed.select((F.col("rank") - 1).alias("rank"), F.col("least").alias("next"))
    shared = materialize(placed.join(after, "rank").select("rank", common_prefix(F.col("most"), F.col("next")).alias("right")), "trie-shared")
    left = shared.select((F.col("rank") + 1).alias("rank"), F.col("right").alias("left"))
    both = placed.select("shard", "rank").join(shared, "rank", "left").join(left, "rank", "left")
    return both.select("shard", F.coalesce("left", F.lit(-1)).alias("left"), F.coalesce("right", F.lit(-1)).alias("right"))


def completed(parts: DataFrame) -> DataFrame:
    """Nodes of all shards, boundary nodes merged, each with its parent's smallest member."""
    open_parts = parts.filter(F.col("prefix").isNotNull())
    merged = materialize(open_parts.groupBy("prefix").agg(
        *(F.min(c).alias(c) for c in ("depth", "turn_id", "first")), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")),
        F.max("end_class").alias("end_class"), F.sum("n_ends").alias("n_ends"), F.min("parent_prefix").alias("parent_prefix")), "trie-merged")
    kept = ["depth", "turn_id", "first", "parent_first", "n_convs", "n_children", "n_leaves", "saved", "end_class", "n_ends"]
    known = merged.select(F.col("prefix").alias("parent_prefix"), F.col("first").alias("parent_first"))
    upper = merged.join(known, "parent_prefix", "left").select(kept)
    own = parts.filter(F.col("prefix").isNull())
    inner = own.filter(F.col("parent_prefix").isNull()).select(kept)
    # A common parent's smallest member goes to each of its shards first, so that its children don't meet in one task.
    by_shard = open_parts.select("shard", F.col("prefix").alias("parent_prefix")).join(known, "parent_prefix")
    outer = own.filter(F.col("parent_prefix").isNotNull()).drop("parent_first").join(by_shard, ["shard", "parent_prefix"]).select(kept)
    return upper.union(inner).union(outer)


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie over (conv_id, ids, chars), and the members (end_class, conv_id) of sequences that several have.

    A node has depth, the number of its last turn, its smallest member ``first`` and that of
    its parent, counts of members, children and leaves, the characters saved in its
    subtree, and the sequence that ends there: its smallest member and the number of its members.
    """
    keyed = materialize(sequences.withColumn("sequence", F.unhex(F.sha2(F.array_join("ids", ","), 256))), "trie-sequences")
    found = keyed.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    classes = keyed.join(found.select("n", "first"), keyed["conv_id"] == F.col("first")).select("ids", "chars", "n", "first")
    # Written before they are dealt out, as sampling the ranges reads them too.
    cut = materialize(in_shards(materialize(classes, "trie-classes"), shard_turns), "trie-cut")
    rows = cut.join(boundaries(cut), "shard").select("shard", "left", "right", "ids", "chars", "n", "first")
    parts = rows.repartition("shard").sortWithinPartitions("shard", "ids").mapInArrow(_grow, NODE)
    several = keyed.select("sequence", "conv_id").join(found.filter("n > 1").select("sequence", F.col("first").alias("end_class")), "sequence")
    return completed(materialize(parts, "trie-parts")), several.select("end_class", "conv_id")


def ends_digests(members: DataFrame, packed_ids: int = PACKED_IDS) -> DataFrame:
    """(end_class, ends_sha256): SHA-256 of the decimal ids of each class, ascending, comma-joined.

    Ids are sorted and packed by ranges, so only packed text of a large class meets in the task that hashes it.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            packed = ([now], [held[0]], [",".join(map(str, held))]) if held else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(packed[0], pa.int64()), pa.array(packed[1], pa.int64()), pa.array(packed[2], pa.string())], names=["end_class", "lead", "packed"])

        for batch in batches:
            for group, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now or len(held) == packed_ids:
                    yield done()
                    now, held = group, []
                held.append(conv)
        yield done()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None

        def done() -> pa.RecordBatch:
            found = ([now], [running.hexdigest()]) if running else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.string())], names=["end_class", "ends_sha256"])

        for batch in batches:
            for group, _, packed in zip(*batch.columns, strict=True):
                if group.as_py() != now:
                    yield done()
                    now, running = group.as_py(), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(packed.as_py().encode())
        yield done()

    ranged = materialize(members.select("end_class", "conv_id"), "trie-members").repartitionByRange("end_class", "conv_id").sortWithinPartitions("end_class", "conv_id")
    packed = materialize(ranged.mapInArrow(pack, "end_class bigint, lead bigint, packed string"), "trie-packed")
    return packed.repartition("end_class").sortWithinPartitions("end_class", "lead").mapInArrow(digest, "end_class bigint, ends_sha256 string")


def with_end_digests(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``ends_sha256``; single ends, and none, need no join."""
    alone = nodes.filter("n_ends < 2").withColumn(
        "ends_sha256", F.sha2(F.when(F.col("n_ends") == 1, F.col("end_class").cast("string")).otherwise(F.lit("")), 256))
    return alone.unionByName(nodes.filter("n_ends > 1").join(ends_digests(members), "end_class").select(alone.columns))

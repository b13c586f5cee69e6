"""Merkle manifest of a dataset: a tree of runs of three per source, and one over the sources.

Every row is a leaf.  The nodes of a tree lie in an append log in order of
completion (postorder).  Aligned builders each take ``BLOCK`` consecutive nodes of
one level, write the log of the subtree above them, and hand its top on; tops are
the next round's nodes, so a tree of any size is built in a few rounds and no
task holds more than one block.  Where a node lies in its log follows from the sizes
of subtrees alone (``position``), so the siblings of a proof are read from the log by
their addresses, without a search.

The fields of a leaf are hashed with their lengths, nulls as ``-``.  A null source
is a source of its own and comes first, as do null ids in a source.  Rows of one id
follow each other by their leaf digest; repeated rows are leaves of their own with
equal digests, and which of them comes first makes no difference to the rows as a
set.  Empty texts are hashed as such and long texts whole.  An empty table has no tree
and no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave.llm.ranks import ranked
from packetweave.storage import materialize

# The leaf's fields in their order, and the nodes of a run.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3
LEVELS = 5
BLOCK = RUN**LEVELS
SIZE = 32
PATH = "array<struct<slot:int,siblings:binary>>"


# Addresses in a log.


def width(n: int, level: int) -> int:
    """Nodes on a level above ``n`` leaves."""
    return -(-n // RUN**level)


def height(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def subtree_size(level: int, index: int, n: int) -> int:
    """Nodes of the subtree of a node, itself included."""
    return sum(min(width(n, low), (index + 1) * RUN ** (level - low)) - index * RUN ** (level - low) for low in range(level + 1))


def first_position(leaf: int) -> int:
    """Where a leaf lies: after all leaves before it and every node completed by them."""
    place = 0
    while leaf:
        place, leaf = place + leaf, leaf // RUN
    return place


def position(level: int, index: int, n: int) -> int:
    """Where a node lies in the log of a tree of ``n`` leaves: last of its subtree."""
    return first_position(index * RUN**level) + subtree_size(level, index, n) - 1


@lru_cache(maxsize=4096)
def _addresses(n: int) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(position(level, i, n) for i in range(width(n, level))) for level in range(height(n) + 1))


# Hashes.


def parent(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def completed(nodes: list[str]) -> list[str]:
    """The log of the tree above these nodes, themselves included, in order of completion."""
    top = height(len(nodes))
    runs: list[list[str]] = [[] for _ in range(top + 1)]
    log = []

    def add(level: int, digest: str) -> None:
        log.append(digest)
        runs[level].append(digest)

    for digest in nodes:
        add(0, digest)
        level = 0
        while level < top and len(runs[level]) == RUN:
            done, runs[level] = parent(runs[level]), []
            level += 1
            add(level, done)
    for level in range(top):
        if runs[level]:
            add(level + 1, parent(runs[level]))
    return log


def padded(nodes: list[str], top: int) -> list[str]:
    """As ``completed``, with single nodes hashed on to level ``top`` as the last block of a larger tree needs."""
    log = completed(nodes)
    return log + chain(log[-1], top - height(len(nodes)))


def chain(digest: str, times: int) -> list[str]:
    found = []
    for _ in range(times):
        digest = parent([digest])
        found.append(digest)
    return found


def siblings(log: list[str], n: int) -> list[list[tuple[int, list[str]]]]:
    """For each of ``n`` nodes its slot and siblings, level by level, read by address."""
    addresses = _addresses(n)
    levels = []
    for level in addresses[:-1]:
        nodes = [log[a] for a in level]
        runs = [nodes[i : i + RUN] for i in range(0, len(nodes), RUN)]
        levels.append([(slot, run[:slot] + run[slot + 1 :]) for run in runs for slot in range(len(run))])
    return [[level[i // RUN**up] for up, level in enumerate(levels)] for i in range(n)]


def folded(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for slot, others in path:
        digest = parent([*others[:slot], digest, *others[slot:]])
    return digest


# Leaves.


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(_field(fields[c]) for c in FIELDS)), 256))


def leaves(docs: DataFrame, altered: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(doc_id, source, leaf, altered): digests of each row and of the row with another text."""
    own = {c: F.col(c) for c in FIELDS}
    other = leaf_digest(own | {"text": altered(docs)}) if altered else leaf_digest(own)
    return docs.select("doc_id", "source", leaf_digest(own).alias("leaf"), other.alias("altered"), F.monotonically_increasing_id().alias("row"))


# Building: one round of aligned builders per LEVELS levels.


def _hexes(column: pa.Array) -> list[str]:
    return [x.hex() for x in column.to_pylist()]


def sealed(nodes: DataFrame) -> DataFrame:
    """(tree, n, block, items, log, top) from ``nodes`` (tree, n, index, item) of one level, the item holding ``digest``.

    ``n`` is the tree's number of nodes on the level, ``log`` the digests of the block in order of completion.
    """
    items = F.transform(F.array_sort(F.collect_list(F.struct("index", "item"))), lambda x: x["item"])
    blocks = nodes.groupBy("tree", "n", F.expr(f"index div {BLOCK}").alias("block")).agg(items.alias("items"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, logs, tops = batch.column(3), [], []
            for n, own in zip(batch.column(1).to_pylist(), held, strict=True):
                inner = _hexes(own.values.field("digest"))
                log = padded(inner, min(LEVELS, height(n)))
                logs.append(bytes.fromhex("".join(log)))
                tops.append(bytes.fromhex(log[-1]))
            columns = [*batch.columns, pa.array(logs, pa.binary()), pa.array(tops, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "log", "top"])

    kinds = dict(blocks.dtypes)
    return blocks.mapInArrow(build, ", ".join(f"{c} {kinds[c]}" for c in blocks.columns) + ", log binary, top binary")


def grown(nodes: DataFrame, most: int, label: str) -> list[DataFrame]:
    """The rounds of all trees, lowest first, each a written table; ``most`` is the size of the largest tree."""
    rounds = []
    while True:
        rounds.append(materialize(sealed(nodes), f"{label}-log"))
        if most <= BLOCK:
            return rounds
        above = rounds[-1].filter(F.col("n") > BLOCK)
        nodes = above.select("tree", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("index"), F.struct(F.col("top").alias("digest")).alias("item"))
        most = width(most, LEVELS)


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, top) of every tree."""
    ended = [r.filter(F.col("n") <= BLOCK).select("tree", "top") for r in rounds]
    every = ended[0]
    for one in ended[1:]:
        every = every.union(one)
    return every


# Proofs: from the highest round down, each block's nodes get the path of the block after their own.


def _under(segments: DataFrame, above: DataFrame | None, ends: DataFrame) -> DataFrame:
    """Segments with path, subroot and root of what lies above their tops."""
    names = ["tree", "block", "items", "log", "path", "subroot", "root"]
    last = segments.filter(F.col("n") <= BLOCK).join(ends, "tree").select(names)
    return last if above is None else last.union(segments.filter(F.col("n") > BLOCK).join(above, ["tree", "block"]).select(names))


def _paths(items: int, log: bytes, above: list[dict] | None) -> Iterator[list[tuple[int, list[str]]]]:
    text = log.hex()
    nodes = [text[i : i + 2 * SIZE] for i in range(0, len(text), 2 * SIZE)]
    # Single nodes that were hashed on have no siblings.
    alone = [(0, [])] * (len(nodes) - subtree_size(height(items), 0, items))
    rest = []
    for step in above or ():
        held = step["siblings"].hex()
        rest.append((step["slot"], [held[i : i + 2 * SIZE] for i in range(0, len(held), 2 * SIZE)]))
    for own in siblings(nodes, items):
        yield [*own, *alone, *rest]


def handed_down(segments: DataFrame) -> DataFrame:
    """(tree, block, path, subroot, root): what lies above each node of these segments, which is a block of the round below."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, items, log, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                paths = [[{"slot": s, "siblings": bytes.fromhex("".join(o))} for s, o in p] for p in _paths(len(items), log, path)]
                count = len(items)
                yield pa.RecordBatch.from_arrays([
                    pa.array([tree] * count, pa.int64()), pa.array(range(block * BLOCK, block * BLOCK + count), pa.int64()),
                    pa.array(paths, pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.binary())]))),
                    pa.array([subroot] * count, pa.binary()), pa.array([root] * count, pa.binary())],
                    names=["tree", "block", "path", "subroot", "root"])

    return segments.mapInArrow(extend, f"tree bigint, block bigint, path {PATH}, subroot binary, root binary")


def above_leaves(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The lowest segments with the path, subroot and root above them; ``ends`` has these for the top of every tree."""
    above = None
    for segments in reversed(rounds[1:]):
        above = handed_down(_under(segments, above, ends))
    return _under(rounds[0], above, ends)


def proofs(segments: DataFrame, key_type: str) -> DataFrame:
    """One row per leaf: digests, the digest of its proof, and the root that the altered leaf leads to."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(batch.schema.names, batch.columns, strict=True))
            rows = zip(own["items"], *(own[c].to_pylist() for c in ("log", "path", "subroot", "root")), strict=True)
            for items, log, path, subroot, root in rows:
                held, count = items.values, len(items)
                leaf, altered = _hexes(held.field("digest")), _hexes(held.field("altered"))
                found = list(_paths(count, log, path))
                ended = [folded(a, p) for a, p in zip(altered, found, strict=True)]
                told = [parent([x for _, others in p for x in others]) for p in found]
                yield pa.RecordBatch.from_arrays([
                    held.field("doc_id"), pa.array(leaf), pa.array([subroot.hex()] * count), pa.array([root.hex()] * count),
                    pa.array(told), pa.array(ended), pa.array([e == root.hex() for e in ended])],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return segments.mapInArrow(prove, f"doc_id {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, altered: Callable[[DataFrame], Column] | None = None) -> dict[str, object]:
    """The trees of ``docs``: ``rounds`` (log segments of the sources' trees), ``sources`` (source, tree, n), ``ends`` (per tree: path, subroot, root)."""
    rows = materialize(leaves(docs, altered), "merkle-leaves")
    placed = ranked(rows, ("source",), ("doc_id", "leaf", "row"), "merkle-order")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = materialize(ranked(sizes, (), ("source",), "merkle-sources", "tree"), "merkle-trees")
    count, most = sources.agg(F.count(F.lit(1)), F.max("n")).first()
    named = placed.join(sources, placed["source"].eqNullSafe(sources["source"])).select(
        "tree", "n", F.col("rank").alias("index"), F.struct(F.col("leaf").alias("digest"), "doc_id", "altered").alias("item"))
    rounds = grown(named, most or 0, "merkle")
    subroots = materialize(tops(rounds), "merkle-subroots")
    whole = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("index"), F.struct(F.col("top").alias("digest")).alias("item"))
    upper = grown(whole, count, "merkle-root")
    end = tops(upper).select("tree", F.array().cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("top").alias("root"))
    paths = handed_down(above_leaves(upper, end)).select(F.col("block").alias("tree"), "path", "root")
    ends = materialize(paths.join(subroots, "tree").select("tree", "path", F.col("top").alias("subroot"), "root"), "merkle-ends")
    return {"rounds": rounds, "sources": sources, "ends": ends}


def audited(docs: DataFrame, altered: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Per row: leaf, subroot, root, digest of the proof, and whether the altered row still leads to the root."""
    trees = manifest(docs, altered)
    return proofs(above_leaves(trees["rounds"], trees["ends"]), dict(docs.dtypes)["doc_id"])


def without_breaks(docs: DataFrame) -> Column:
    """The text, with line ends deleted where 2 divides the CRC-32 of the decimal id; null ids keep their text."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))

"""SimHash near-duplicates through an index of fingerprint bytes by position.

Fingerprints at 3 or fewer differing bits share at least 5 of their 8 bytes in
place.  Postings of one byte hold a 256th of all fingerprints each, so counting
through them emits about N*N/64 pairs.  The index therefore posts three bytes at
once: with the triples of each half of the positions, any 5 shared bytes contain
a posted triple.  In each posting, pairs are tallied for shared positional bytes,
those with the guaranteed minimum are kept, and their bits are compared.

Fingerprints are big-endian bytes.  Whole near copies at a lower similarity are ``shingles``' work.

Equal fingerprints meet once, as one class.  A posting of more than ``TILE`` fingerprints is
dealt out as pairs of tiles, and each task returns a spanning forest of the
links it finds rather than all of them.

Texts without words, null ones too, have fingerprint zero and are linked like
any other.  Documents with null ids get a component but name none.  Repeated rows are kept.  An
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.llm.components import components
from packetweave.storage import materialize

# Fixed values of the narrow fingerprint.
SHINGLE, SEED, BITS = 3, 42, 3
TILE = 2048
# Rows that a task holds at a time besides one posting, and links it holds before it merges them.
ROWS, LINKS = 1 << 16, 1 << 20


@dataclass(frozen=True)
class Design:
    """What is hashed, how many words of 64 bits, the most differing bits, the posted positions."""

    shingle: int
    words: int
    bits: int
    triples: tuple[tuple[int, int, int], ...]

    @property
    def least_shared(self) -> int:
        """Shared positional bytes that a pair must have: what is guaranteed, or a posted triple."""
        return max(3, 8 * self.words - self.bits)


NARROW = Design(SHINGLE, 1, BITS, (*combinations(range(4), 3), *combinations(range(4, 8), 3)))


def _further(hashes: np.ndarray, word: int) -> np.ndarray:
    """Independent hashes for the next words: multiply and shift, as splitmix64 does."""
    if word == 0:
        return hashes
    mixed = hashes + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def fingerprint(text: bytes, design: Design = NARROW) -> bytes:
    """A bit is set when it is set in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return bytes(8 * design.words)
    digest, size = xxhash.xxh64_intdigest, min(design.shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = len(words) - size + 1
    spans = zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, count), design)


def majority(hashes: np.ndarray, design: Design = NARROW) -> bytes:
    """The fingerprint of hashes: the bits that are set in over half of them."""
    made = []
    for word in range(design.words):
        bits = np.unpackbits(_further(hashes, word).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        made.append(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes())
    return b"".join(made)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", design: Design = NARROW) -> DataFrame:
    """(doc_id, fp) of every document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", design) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "fp"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary"))
    return rows.mapInArrow(of, f"doc_id {dict(rows.dtypes)['doc_id']}, fp binary")


def _postings(distinct: DataFrame, design: Design) -> DataFrame:
    """(posting, pair of tiles, fp): one row per fingerprint and posted triple, more in tiled postings."""
    byte = lambda i: F.substring("fp", i + 1, 1)
    keys = [F.concat(F.lit(bytes([n])), byte(a), byte(b), byte(c)) for n, (a, b, c) in enumerate(design.triples)]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("posting"))
    full = rows.groupBy("posting").count().filter(F.col("count") > TILE)
    tiles = materialize(full.select("posting", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "full-postings")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.least(own, o) * 32768 + F.greatest(own, o))
    dealt = rows.join(tiles, "posting", "left")
    return dealt.select("fp", "posting", F.explode(F.when(F.col("tiles").isNotNull(), pairs).otherwise(F.array(F.lit(0)))).alias("pair"))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a and b: the smallest row of each connected set."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, np.concatenate([x, y]), np.concatenate([low, low]))
        while not np.array_equal(label, shorter := label[label]):
            label = shorter


def forest(group: np.ndarray, fp: np.ndarray, design: Design) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose links connect what is near in each run of equal ``group``; fp: 64-bit words by row."""
    n = len(fp)
    label, a, b, held = np.arange(n), [], [], 0
    rows, shift = np.arange(n), 1
    while len(rows := rows[rows + shift < n]):
        rows = rows[group[rows] == group[rows + shift]]
        differ = fp[rows] ^ fp[rows + shift]
        near = np.flatnonzero((differ.view(np.uint8) == 0).sum(axis=1) >= design.least_shared)
        near = near[np.bitwise_count(differ[near]).sum(axis=1) <= design.bits]
        linked = rows[near]
        a.append(linked)
        b.append(linked + shift)
        held += len(linked)
        if held >= LINKS:
            label, a, b, held = _merge(label, np.concatenate(a), np.concatenate(b)), [], [], 0
        shift += 1
    if held:
        label = _merge(label, np.concatenate(a), np.concatenate(b))
    apart = np.flatnonzero(label != np.arange(n))
    return apart, label[apart]


def links(distinct: DataFrame, design: Design = NARROW) -> DataFrame:
    """(u, v) links between distinct fingerprints that keep every connection the index finds."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def words(column: pa.Array, kind: type, n: int) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, n)

        def done(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            ends = [pa.array([x.tobytes() for x in fp[rows]], pa.binary()) for rows in forest(group, fp, design)]
            return pa.RecordBatch.from_arrays(ends, names=["u", "v"])

        group, fp = np.empty(0, np.int64), np.empty((0, design.words), np.uint64)
        for batch in batches:
            fp = np.concatenate([fp, words(batch.column(0), np.uint64, design.words)])
            posting = words(batch.column(1), np.uint32, 1)[:, 0].astype(np.int64)
            group = np.concatenate([group, posting << 31 | batch.column(2).to_numpy()])
            if len(group) >= ROWS:
                cut = np.flatnonzero(group != group[-1])
                if len(cut):
                    cut = cut[-1] + 1
                    yield done(group[:cut], fp[:cut])
                    group, fp = group[cut:], fp[cut:]
        yield done(group, fp)

    dealt = _postings(distinct, design).select("fp", "posting", "pair")
    sorted_rows = dealt.repartition("posting", "pair").sortWithinPartitions("posting", "pair")
    return sorted_rows.mapInArrow(connect, "u binary, v binary").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", design: Design = NARROW) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over near fingerprints."""
    prints = materialize(fingerprints(docs, key, text, design), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    found = components(links(classes.select("fp"), design))
    placed = materialize(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")), "fingerprint-places")
    smallest = materialize(placed.groupBy("component").agg(F.min("first").alias("component_id")), "component-ids")
    # All are written, so that a component or fingerprint with many members can be split in the joins.
    named = materialize(placed.join(smallest, "component").select("fp", "component_id"), "fingerprint-components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: ``shingles.one_of_each``, which takes candidates from this index."""
    from packetweave.llm import shingles

    return shingles.one_of_each(docs)

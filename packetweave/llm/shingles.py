"""Near copies by the exact Jaccard similarity of five-word shingles.

A text's set is that of its shingles' 64-bit hashes; texts of equal sets are one class.
Candidates come from two sources.  The fingerprint of each set goes through the index of
``simhash``: postings of bytes by position, tally of shared bytes, comparison of bits; it
meets every pair at 3 or fewer differing bits.  As bits can't decide at 0.8, minhash bands meet the
others: ``BANDS`` of ``ROWS`` minima each, so that a pair at
similarity s is met with probability 1 - (1 - s^ROWS)^BANDS: all but 5 in ten million at 0.8.
Each band or fingerprint links its members to the smallest one, so links are linear in the members, and
the components of all links hold all candidates.

Within a component every pair is counted exactly from the texts; those at ``LEAST`` or more are
links, the others are not.  Components of more than ``TILE`` classes are dealt out as pairs of
tiles.  Each task returns a spanning forest of the links that it finds.

Texts of fewer words than a shingle are one shingle; those without words, null ones too, are copies
of each other.  Null ids are last, repeated rows are kept once, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.llm import simhash
from packetweave.llm.components import components
from packetweave.llm.rows import row_key, unused
from packetweave.storage import materialize

SHINGLE, SEED = 5, 42
# Least similarity as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 48, 6
TILE = 256
# Hashes times minima that are held at a time.
SLICE = 512
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted different hashes of the shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, size = xxhash.xxh64_intdigest, min(SHINGLE, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = len(words) - size + 1
    spans = zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, count))


def bands(hashes: np.ndarray) -> list[int]:
    """One number per band, different for different bands; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLICE):
        np.minimum(least, (hashes[at : at + SLICE, None] * _FACTORS).min(axis=0), out=least)
    minima = least.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), n) - (1 << 63) for n, row in enumerate(minima)]


def set_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, fp, bands): node is a digest of the set, fp its fingerprint, null for an empty set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"") for t in batch.column(1)]
            nodes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            prints = pa.array([simhash.majority(s) if len(s) else None for s in sets], pa.binary())
            met = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, prints, met], names=["key", "node", "fp", "bands"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary"))
    return rows.mapInArrow(of, f"key {dict(rows.dtypes)['key']}, node binary, fp binary, bands array<bigint>")


def print_links(classes: DataFrame) -> DataFrame:
    """(u, v) between nodes whose fingerprints are equal or linked by the index of ``simhash``."""
    prints = classes.select("node", "fp").filter("fp is not null")
    firsts = materialize(prints.groupBy("fp").agg(F.min("node").alias("v")), "fingerprint-firsts")
    near = materialize(simhash.links(firsts.select("fp")), "fingerprint-links")
    low, high = (firsts.select(F.col("fp").alias(e), F.col("v").alias(f"{e}_node")) for e in ("u", "v"))
    apart = near.join(low, "u").join(high, "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    return prints.join(firsts, "fp").select(F.col("node").alias("u"), "v").union(apart)


def candidates(classes: DataFrame) -> DataFrame:
    """(node, component): nodes that the fingerprint index or some band joins with others."""
    rows = classes.select("node", F.explode("bands").alias("band"))
    met = rows.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v <> most")
    met = materialize(met.select("band", "v"), "bands-met")
    banded = rows.join(met, "band").select(F.col("node").alias("u"), "v")
    return components(print_links(classes).union(banded).filter("u <> v").distinct())


def forest(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Links that connect what pairs of at least that similarity connect; overlaps are counted exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    place = np.repeat(np.arange(len(sets)), sizes)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    label, found = np.arange(len(sets)), []
    seen = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    for i in range(len(sets) - 1):
        seen[codes[starts[i] : starts[i + 1]]] = True
        rest = starts[i + 1]
        shared = np.bincount(place[rest:][seen[codes[rest:]]], minlength=len(sets))
        seen[codes[starts[i] : starts[i + 1]]] = False
        # shared / (both - shared) >= a / b, in whole numbers
        near = (shared > 0) & (shared * sum(least) >= least[0] * (sizes + sizes[i]))
        for j in np.flatnonzero(near).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                found.append((i, j))
    return found


def links(texts: DataFrame) -> DataFrame:
    """(u, v) between nodes whose sets are near, from (component, node, text) with one row per node."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def done() -> pa.RecordBatch:
            ends = forest(sets) if len(sets) > 1 else []
            parts = [pa.array([nodes[e[side]] for e in ends], pa.binary()) for side in (0, 1)]
            return pa.RecordBatch.from_arrays(parts, names=["u", "v"])

        for batch in batches:
            for component, pair, node, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                now = (component.as_py(), pair.as_py())
                if now != group:
                    yield done()
                    group, nodes, sets = now, [], []
                nodes.append(node.as_py())
                sets.append(shingle_set(text.as_py()))
        yield done()

    full = texts.groupBy("component").count().filter(F.col("count") > TILE)
    tiles = materialize(full.select("component", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "full-components")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    # A pair of a tile with itself is part of each of its other pairs.
    pairs = F.transform(F.filter(others, lambda o: o != own), lambda o: F.least(own, o) * 32768 + F.greatest(own, o))
    dealt = texts.join(tiles, "component", "left").select(
        "component", F.explode(F.when(F.col("tiles").isNotNull(), pairs).otherwise(F.array(F.lit(0)))).alias("pair"), "node", "text")
    return dealt.repartition("component", "pair").sortWithinPartitions("component", "pair").mapInArrow(connect, "u binary, v binary").distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group that near copies connect: that with the smallest id, nulls last.

    Of rows equal in id and text one stays.
    """
    key = unused(docs.columns, "row_key")
    # Copies of a row meet before the shuffle, so that many of them don't gather in one task.
    rows = docs.withColumn(key, row_key("doc_id", "text")).dropDuplicates([key])
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("key"))
    named = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    found = set_classes(named.select(order.alias("order"), "text"), "order", "text")
    classes = materialize(found.groupBy("node").agg(F.min("key").alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "set-classes")
    grouped = materialize(candidates(classes), "candidates")
    # A text of each class that has candidates; Spark checks whether these few columns can be broadcast.
    wanted = materialize(classes.join(grouped, "node").select(F.col("first.key").alias("key"), "node", "component"), "candidate-keys")
    texts = named.select("key", F.col("text").cast("binary").alias("text")).join(wanted, "key").groupBy("component", "node").agg(F.min("text").alias("text"))
    near = components(links(materialize(texts, "candidate-texts")))
    placed = materialize(classes.join(near.withColumnRenamed("component", "group"), "node", "left").select(
        "first", F.coalesce("group", "node").alias("group")), "set-places")
    kept = materialize(placed.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key)), "near-copies-kept")
    return rows.join(kept, key, "left_semi").select(*docs.columns)

"""Removal of repeated substrings by a distributed difference cover of the suffixes.

A byte goes when a string of ``LENGTH`` bytes covers it that also starts in a
document with a smaller id.  So suffixes need to be told apart by their first
``LENGTH`` bytes only, and the difference-cover algorithm stops at that depth:

1. Sampled suffixes start at the residues of a difference cover modulo 31.  For
   any two positions some shift below 31 takes both to sampled ones, so equal
   50-byte strings share a 20-byte tuple that is sampled in both.  Tuples are sorted and
   named by their hash; a name met in one document only is out.
2. The suffixes next to the named ones that are left, sampled or not, are merged
   into one order by their first 50 bytes, and equal neighbours give the smallest document.

Documents are packed into chunks, written once as a table bucketed by chunk.
Tasks ask about the sorted hashes of a chunk, packed by range of hashes, and get
one bit for each back; the text itself never moves again.  A hash is asked for once per chunk, so a string in
a third of all documents doesn't gather in one task.  Exact copies are found first, by
digest, and take no part.

Null texts are empty.  Documents without id are kept whole and count for no other; those with equal
ids aren't smaller than each other.  Repeated rows are judged alike.  Texts are
compared as whole byte strings, 64 bits of hash standing for the 50 bytes.  An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetweave.storage import materialize

LENGTH = 50
# A difference cover: every residue modulo 31 is a difference of two of these.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
TUPLE = LENGTH - MODULUS + 1
CHUNK_BYTES = 8 << 20
# Sampled tuples per task that sorts them, and how many bits names have beyond their number.
NAMES_PER_BUCKET, SPARE_BITS = 1 << 20, 9
FACTORS = tuple(np.uint64(c) for c in (
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2^64, compressed by byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max((i + 1 for i in range(8) if planes[i].any()), default=0)
    return bytes([used]) + len(values).to_bytes(5, "little") + pa.compress(planes[:used].tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    used, n = data[0], int.from_bytes(data[1:6], "little")
    planes = np.zeros((8, n), np.uint8)
    if used:
        planes[:used] = np.frombuffer(pa.decompress(data[6:], used * n, codec="zstd", asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8")[:, 0].astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class Chunk:
    """Packed documents: places of samples and candidates, and their hashes."""

    def __init__(self, ids: list, lengths: list[int], blob: bytes, copies: Iterable[int]):
        self.blob, self.lengths = blob, np.array(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.live = self.lengths >= LENGTH
        self.live &= np.array([i is not None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.live[list(copies)] = False
        size = max(0, len(blob) - 7)
        self.words = np.ndarray((size,), "<u8", blob, 0, (1,)) if size else np.empty(0, np.uint64)
        most = int(self.lengths[self.live].max(initial=0)) - TUPLE + 1
        rounds = np.arange(0, max(most, 0), MODULUS)[:, None] + np.array(COVER)
        self.pattern = rounds.ravel()

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        found = np.zeros(len(at), np.uint64)
        for offset, factor in zip([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])], FACTORS, strict=False):
            found ^= self.words[at + offset]
            found *= factor
            found ^= found >> np.uint64(29)
        return found * FACTORS[0] ^ found >> np.uint64(32)

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, document, name) of the sampled tuples of live documents."""
        live = np.flatnonzero(self.live)
        counts = np.searchsorted(self.pattern, self.lengths[live] - TUPLE, side="right")
        at = [self.starts[d] + self.pattern[:n] for d, n in zip(live, counts, strict=True)]
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        return at, np.repeat(live, counts), self.hashes(at, TUPLE) >> np.uint64(64 - bits)

    def names(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions and documents of samples, their places among the names, the names, and which several documents here hold."""
        at, doc, name = self.samples(bits)
        order = np.argsort(name, kind="stable")
        begins = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]]) if len(order) else order
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(order)]))
        several = np.zeros(len(begins), bool)
        if len(order):
            ids = self.ids[doc[order]]
            several = np.minimum.reduceat(ids, begins) != np.maximum.reduceat(ids, begins)
        return at, doc, place, name[order][begins], several

    def candidates(self, bits: int, answers: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, document) of the strings that hold a name known from several documents."""
        at, doc, place, names, several = self.names(bits)
        flagged = (several | answered(names, answers, bits, buckets))[place]
        at, doc = at[flagged], doc[flagged]
        first = np.maximum(self.starts[doc], at - (MODULUS - 1))
        last = np.minimum(at, self.ends[doc] - LENGTH)
        some = first <= last
        change = np.bincount(first[some], minlength=len(self.blob) + 1) - np.bincount(last[some] + 1, minlength=len(self.blob) + 1)
        found = np.flatnonzero(np.cumsum(change))
        return found, np.searchsorted(self.ends, found, side="right")

    def strings(self, bits: int, answers: list[dict] | None, buckets: int) -> tuple[np.ndarray, ...]:
        """Candidates with the ids of their documents, their places among the sorted strings, those, and the smallest id of each."""
        at, doc = self.candidates(bits, answers, buckets)
        found, ids = self.hashes(at, LENGTH), self.ids[doc]
        order = np.argsort(found, kind="stable")
        begins = np.flatnonzero(np.r_[True, found[order][1:] != found[order][:-1]]) if len(order) else order
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(order)]))
        smallest = np.minimum.reduceat(ids[order], begins) if len(order) else ids
        return at, ids, place, found[order][begins], smallest


def ranges(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where the values of each range of hashes begin, and the end."""
    width = (1 << bits) // buckets
    bounds = np.array([i * width for i in range(buckets)], np.uint64)
    return np.r_[np.searchsorted(values, bounds), len(values)]


def answered(values: np.ndarray, answers: list[dict] | None, bits: int, buckets: int) -> np.ndarray:
    found, cuts = np.zeros(len(values), bool), ranges(values, bits, buckets)
    for answer in answers or ():
        a, b = cuts[answer["bucket"]], cuts[answer["bucket"] + 1]
        found[a:b] = np.unpackbits(np.frombuffer(answer["flags"], np.uint8), count=b - a)
    return found


def write_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Packs documents into chunks and writes them bucketed by chunk; returns the table's name."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, digests, texts, size = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            made = [[uuid.uuid4().int >> 65], [ids], [lengths], [digests], [b"".join(texts)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=["chunk", "ids", "lengths", "digests", "blob"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                ids.append(key)
                lengths.append(len(text))
                digests.append(hashlib.sha256(text).digest())
                texts.append(text)
                size += len(text)
                if size >= chunk_bytes:
                    yield row()
                    ids, lengths, digests, texts, size = [], [], [], [], 0
        if ids:
            yield row()

    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    chunks = rows.mapInArrow(packed, "chunk long, ids array<long>, lengths array<long>, digests array<binary>, blob binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    return name


def copies_of(chunks: DataFrame) -> DataFrame:
    """(chunk, copies): places of documents whose whole text a smaller id has too."""
    docs = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "digests")).alias("place", "d")).select(
        "chunk", "place", F.col("d.ids").alias("id"), F.col("d.digests").alias("digest")).filter("id is not null")
    firsts = materialize(docs.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first-copies")
    return materialize(docs.join(firsts, "digest").filter("id > first").groupBy("chunk").agg(F.collect_list("place").alias("copies")), "copies")


def _asked(chunks: DataFrame, ask, kinds: str) -> DataFrame:
    """Rows that ``ask`` yields for each chunk: (bucket, chunk, values and the like)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from ask(row)

    return chunks.mapInArrow(rows, kinds)


def _chunk(row: dict) -> Chunk:
    return Chunk(row["ids"], row["lengths"], row["blob"], row["copies"] or ())


ASKED = "bucket int, chunk long, sorted binary, ids binary, least long"


def _questions(row: dict, values: np.ndarray, bits: int, buckets: int, ids: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    cuts, made = ranges(values, bits, buckets), [[], [], [], [], []]
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[bucket], cuts[bucket + 1]
        least = int(ids[a:b].min()) if ids is not None else 0
        own = pack((ids[a:b] - least).astype(np.uint64)) if ids is not None else b""
        # Sorted values start from the range's lower end.
        base = np.uint64(bucket * ((1 << bits) // buckets))
        for column, x in zip(made, (bucket, row["chunk"], pack_sorted(values[a:b] - base), own, least), strict=True):
            column.append(x)
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=["bucket", "chunk", "sorted", "ids", "least"])


def _answer(table: pa.Table) -> pa.Table:
    """Bits for every asked value: known to several chunks or, with ids, to a smaller id."""
    parts = [unpack_sorted(x) for x in table["sorted"].to_pylist()]
    values = np.concatenate(parts)
    order = np.argsort(values, kind="stable")
    begins = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])
    sizes = np.diff(np.r_[begins, len(order)])
    flags = np.empty(len(values), bool)
    if table["ids"][0].as_py():
        ids = np.concatenate([unpack(x).astype(np.int64) + y for x, y in zip(table["ids"].to_pylist(), table["least"].to_pylist(), strict=True)])
        flags[order] = np.repeat(np.minimum.reduceat(ids[order], begins), sizes) < ids[order]
    else:
        flags[order] = np.repeat(sizes > 1, sizes)
    cuts = np.cumsum([0, *map(len, parts)])
    bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "flags": pa.array(bits, pa.binary())})


def _answers(asked: DataFrame, name: str) -> DataFrame:
    bits = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, flags binary")
    return materialize(bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags")).alias(name)), f"answers-{name}")


def _removed(chunk: Chunk, row: dict, bits: int, buckets: int) -> pa.RecordBatch:
    at, ids, place, strings, smallest = chunk.strings(bits, row["named"], buckets)
    later = answered(strings, row["merged"], 64, buckets)[place] | (ids > smallest[place])
    at = at[later]
    change = np.bincount(at, minlength=len(chunk.blob) + 1) - np.bincount(at + LENGTH, minlength=len(chunk.blob) + 1)
    gone = np.cumsum(change)[:-1] > 0
    copies, kept, made = set(row["copies"] or ()), np.frombuffer(chunk.blob, np.uint8), [[], [], [], [], []]
    for d, (key, length) in enumerate(zip(row["ids"], row["lengths"], strict=True)):
        own = gone[chunk.starts[d] : chunk.ends[d]]
        if d in copies and length >= LENGTH:
            removed, spans, digest = length, 1, hashlib.sha256(b"")
        elif own.any():
            removed, spans = int(own.sum()), int(own[0]) + int((own[1:] & ~own[:-1]).sum())
            digest = hashlib.sha256(kept[chunk.starts[d] : chunk.ends[d]][~own].tobytes())
        else:
            removed, spans, digest = 0, 0, None
        sha = digest.hexdigest() if digest else row["digests"][d].hex()
        for column, x in zip(made, (key, length, removed, spans, sha), strict=True):
            column.append(x)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(spark: SparkSession, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    name = write_chunks(docs, chunk_bytes)
    chunks = spark.table(name)
    total = chunks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    samples = total * len(COVER) // MODULUS + 1
    buckets = 1 << max(2, (samples // NAMES_PER_BUCKET).bit_length())
    bits = min(64, samples.bit_length() + SPARE_BITS)
    asked = chunks.join(copies_of(chunks), "chunk", "left")
    named = _answers(_asked(asked, lambda r: _questions(r, _chunk(r).names(bits)[3], bits, buckets), ASKED), "named")
    asked = asked.join(named, "chunk", "left")

    def strings(row: dict) -> Iterator[pa.RecordBatch]:
        _, _, _, found, smallest = _chunk(row).strings(bits, row["named"], buckets)
        yield from _questions(row, found, 64, buckets, smallest)

    merged = _answers(_asked(asked, strings, ASKED), "merged")
    result = _asked(asked.join(merged, "chunk", "left"), lambda r: iter([_removed(_chunk(r), r, bits, buckets)]), RESULT)
    result = materialize(result, "without-repeats")
    spark.sql(f"drop table {name} purge")
    return result

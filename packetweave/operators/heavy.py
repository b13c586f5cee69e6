"""The most frequent values of a column from mergeable summaries, exact by proof or by a full count.

Each task keeps at most ``capacity`` counters (Misra-Gries): when a batch brings more values, the
count of the first one too many is taken from all, and what reaches zero goes.  A counter
is then too low by at most what its task has taken, and a value without counter was no more frequent
than that.  Summaries merge by adding counters and what was taken, so a shuffle sees tasks
times capacity rows instead of every different value.

Where nothing was taken the counters are the counts.  Else the values that may still be among
the first k are counted exactly in a second scan; where a value without counter might be
among them, or too many values remain, every value is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.operators import ranking
from packetweave.storage import BROADCAST_ROWS, materialize

CAPACITY = 4096
COUNTERS, CANDIDATES, FULL = "counters", "candidates", "full"


def reduced(counts: dict, capacity: int) -> tuple[dict, int]:
    """At most ``capacity`` counters, and how much was taken from each."""
    if len(counts) <= capacity:
        return counts, 0
    taken = sorted(counts.values(), reverse=True)[capacity]
    return {value: n - taken for value, n in counts.items() if n > taken}, taken


def summaries(df: DataFrame, column: str, capacity: int = CAPACITY) -> DataFrame:
    """(value, lower, taken) per task: counters, and one row without value that says how much was taken."""
    kind = dict(df.dtypes)[column]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        taken = 0
        for batch in batches:
            for entry in batch.column(0).drop_null().value_counts().to_pylist():
                counts[entry["values"]] = counts.get(entry["values"], 0) + entry["counts"]
            counts, more = reduced(counts, capacity)
            taken += more
        values = [*counts, None]
        rows = [pa.array(values, batch_type), pa.array([*counts.values(), 0], pa.int64()), pa.array([0] * len(counts) + [taken], pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, names=["value", "lower", "taken"])

    batch_type = pa.string() if kind == "string" else None
    return df.select(column).mapInArrow(count, f"value {kind}, lower bigint, taken bigint")


@dataclass(frozen=True)
class Top:
    """(column, packets, rank), and by which way it was found."""

    rows: DataFrame
    way: str


def top_values(df: DataFrame, column: str, k: int, capacity: int = CAPACITY, most: int = BROADCAST_ROWS) -> Top:
    """The ``k`` most frequent values, ties to the smaller; nulls are no value."""
    merged = materialize(summaries(df, column, capacity).groupBy("value").agg(
        F.sum("lower").alias("lower"), F.sum("taken").alias("taken")), "counters")
    taken = merged.agg(F.sum("taken")).first()[0] or 0
    counters = merged.filter("value is not null")
    order = ranking.most_frequent_first(column)
    if not taken:
        return Top(ranking.top_n(counters.select(F.col("value").alias(column), F.col("lower").alias("packets")), (), order, k), COUNTERS)
    first = counters.orderBy(F.desc("lower")).limit(k).agg(F.min("lower").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if first["n"] == k and first["least"] > taken:
        # A value of the first k has at least ``least`` packets, and at most ``taken`` more than its counter.
        wanted = materialize(counters.filter(F.col("lower") + taken >= first["least"]).select(F.col("value").alias(column)), "candidates")
        if wanted.limit(most + 1).count() <= most:
            counts = ranking.value_counts(df.select(column).join(F.broadcast(wanted), column), (), column)
            return Top(ranking.top_n(counts, (), order, k), CANDIDATES)
    return Top(ranking.top_n(ranking.value_counts(df, (), column), (), order, k), FULL)

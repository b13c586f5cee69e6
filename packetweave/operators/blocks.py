"""Nearest centres over Arrow blocks of packets, of the whole input or of few scopes.

The scope rows (means, scales, centres) travel to each task with the function; their number is checked
before.  Distances are summed feature by feature in the order of ``kmeans.nearest``, so both agree on ties.
Written out as SQL, the terms of some dozens of coordinates make methods too long to be compiled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.operators.scaling import ABSENT


class Scopes:
    """The numbers of all scopes as arrays, and the place of each key in them."""

    def __init__(self, rows: list, by: tuple[str, ...], d: int, k: int) -> None:
        # Null keys match nothing, as in a join.
        rows = [r for r in rows if all(r[c] is not None for c in by)]
        self.by, self.d, self.k = by, d, k
        self.place = {tuple(r[c] for c in by): i for i, r in enumerate(rows)}
        self.means = np.array([r["means"] for r in rows], float).reshape(-1, d)
        self.inverse = 1.0 / np.array([r["scales"] for r in rows], float).reshape(-1, d)
        centres = [[c if c is not None else [ABSENT] * d for c in (r["centres"] or [None] * k)] for r in rows]
        self.centres = np.array(centres, float).reshape(-1, k, d)

    def of(self, keys: list[pa.Array], n: int) -> np.ndarray:
        """Place of the scope of each row, -1 where there is none."""
        if not self.by:
            return np.zeros(n, np.int64)
        return np.fromiter(map(self.place.get, zip(*(c.to_pylist() for c in keys), strict=True), repeat(-1)), np.int64, n)

    def nearest(self, at: np.ndarray, values: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Standardised columns (d x n), label and distance of rows whose scopes are known."""
        z = np.empty((self.d, len(at)))
        for j, column in enumerate(values):
            z[j] = (column.to_numpy(zero_copy_only=False) - self.means[at, j]) * self.inverse[at, j]
        squares = np.zeros((self.k, len(at)))
        for i in range(self.k):
            for j in range(self.d):
                gap = z[j] - self.centres[at, i, j]
                squares[i] += gap * gap
        label = np.where(np.isnan(squares), np.inf, squares).argmin(axis=0)
        return z, label, np.sqrt(squares[label, np.arange(len(at))])


def doubles(names: tuple[str, ...]) -> list:
    return [F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias(f"_x{j}") for j, n in enumerate(names)]


def cluster_means(features: DataFrame, names: tuple[str, ...], rows: list, by: tuple[str, ...], k: int, places: int) -> DataFrame:
    """One step: ``(*by, cluster_id, centre)`` with rounded means; blocks are summed before they meet."""
    d = len(names)
    scopes, sums = Scopes(rows, by, d, k), [f"_s{j}" for j in range(len(names))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = scopes.of(batch.columns[: len(by)], batch.num_rows)
            known = np.flatnonzero(at >= 0)
            table = batch if len(known) == len(at) else batch.take(pa.array(known))
            at = at[known]
            z, label, _ = scopes.nearest(at, table.columns[len(by) :])
            _, first, group = np.unique(at * k + label, return_index=True, return_inverse=True)
            totals = [pa.array(np.bincount(group, weights=x, minlength=len(first))) for x in z]
            counts = pa.array(np.bincount(group, minlength=len(first)), pa.int64())
            keys = [c.take(pa.array(first)) for c in table.columns[: len(by)]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(label[first], pa.int32()), counts, *totals], names=[*by, "cluster_id", "_n", *sums])

    source = features.select(*by, *doubles(names))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*by).schema.fields]
    summed = source.mapInArrow(add, ", ".join([*kinds, "cluster_id int, _n bigint", *(f"{s} double" for s in sums)]))
    total = F.sum("_n")
    return summed.groupBy(*by, "cluster_id").agg(F.array(*[F.round(F.sum(s) / total, places) for s in sums]).alias("centre"))


def labelled(stored: DataFrame, names: tuple[str, ...], rows: list, by: tuple[str, ...], k: int) -> DataFrame:
    """``stored`` with ``cluster_id`` and ``distance``, null where the scope is unknown."""
    d, width = len(names), len(stored.columns)
    scopes = Scopes(rows, by, d, k)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            at = scopes.of([batch.column(stored_at) for stored_at in key_places], n)
            known = np.flatnonzero(at >= 0)
            ids, distances = np.zeros(n, np.int32), np.zeros(n)
            if len(known):
                pick = pa.array(known)
                _, ids[known], distances[known] = scopes.nearest(at[known], [c.take(pick) for c in batch.columns[width:]])
            none = at < 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(ids, pa.int32(), mask=none), pa.array(distances, mask=none)], names=[*batch.schema.names[:width], "cluster_id", "distance"])

    key_places = [stored.columns.index(c) for c in by]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    return stored.select("*", *doubles(names)).mapInArrow(label, f"{kinds}, cluster_id int, distance double")

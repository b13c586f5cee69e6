"""Two principal components of the standardised features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave.storage import materialize


@dataclass(frozen=True)
class Components:
    """Loadings (component x feature) and explained-variance ratios."""

    features: tuple[str, ...]
    loadings: tuple[tuple[float, ...], ...]
    ratios: tuple[float, ...]

    def projections(self, names: list[str]) -> list[Column]:
        """One expression per component over standardised columns."""
        out = []
        for number, weights in enumerate(self.loadings, 1):
            total = sum((F.col(n) * F.lit(w) for n, w in zip(names, weights)), F.lit(0.0))
            out.append(total.alias(f"pc{number}"))
        return out


@dataclass(frozen=True)
class ScopedComponents:
    """One row per scope: keys, ``loadings`` (component x feature) and ``ratios``."""

    features: tuple[str, ...]
    by: tuple[str, ...]
    k: int
    rows: DataFrame

    def projections(self, names: list[str]) -> list[Column]:
        """One expression per component over standardised columns next to ``loadings``."""
        out = []
        for number in range(self.k):
            weights = F.col("loadings")[number]
            total = sum((F.col(n) * weights[i] for i, n in enumerate(names)), F.lit(0.0))
            out.append(total.alias(f"pc{number + 1}"))
        return out


def _moments(names: list[str]) -> list[Column]:
    """Means, and mean products of the pairs ``i <= j`` in order."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return [
        F.array(*[F.avg(c) for c in names]).alias("m"),
        F.array(*[F.avg(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("p"),
    ]


def _matrix(means, products) -> np.ndarray:
    d = len(means)
    matrix, at = np.zeros((d, d)), 0
    for i in range(d):
        for j in range(i, d):
            matrix[i, j] = matrix[j, i] = products[at] - means[i] * means[j]
            at += 1
    return matrix


def covariance(scaled: DataFrame, names: list[str]) -> np.ndarray:
    """Population covariance of the ``z`` columns from one aggregation."""
    row = scaled.agg(*_moments(names)).first()
    return _matrix(row["m"], row["p"])


def principal_components(scaled: DataFrame, names: list[str], features: tuple[str, ...], k: int = 2) -> Components:
    """Eigenvectors of the d x d covariance; the data is touched once, in Spark."""
    picked, ratios = leading(covariance(scaled, names), k)
    return Components(tuple(features), picked, ratios)


def leading(matrix: np.ndarray, k: int) -> tuple[tuple[tuple[float, ...], ...], tuple[float, ...]]:
    """Loadings and ratios of the first k components of a covariance matrix.

    Each component's sign is set so that its largest loading is positive.
    """
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    picked = []
    for column in order:
        weights = vectors[:, column]
        weights = weights * np.sign(weights[np.argmax(np.abs(weights))])
        picked.append(tuple(float(w) for w in weights))
    total = float(values.sum())
    ratios = tuple(float(values[c]) / total if total > 0 else 0.0 for c in order)
    return tuple(picked), ratios


def _scoped_moments(scaled: DataFrame, names: list[str], by: tuple[str, ...]) -> DataFrame:
    """``_moments`` of every scope, from sums of blocks: the products of a block are one small matrix product per scope."""
    d = len(names)
    sums = [f"_s{i}" for i in range(d)] + [f"_p{i}" for i in range(d * (d + 1) // 2)]
    upper = np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(by) :]]).T
            codes = np.zeros(batch.num_rows, np.int64)
            for column in batch.columns[: len(by)]:
                own = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
                codes = np.unique(codes * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            parts = [z[rows] for rows in np.split(order, starts[1:])] if len(starts) else []
            table = np.array([[*p.sum(axis=0), *(p.T @ p)[upper]] for p in parts]).reshape(len(parts), len(sums))
            keys = [c.take(pa.array(order[starts])) for c in batch.columns[: len(by)]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([len(p) for p in parts], pa.int64()), *map(pa.array, table.T)], names=[*by, "_n", *sums])

    source = scaled.select(*by, *names)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*by).schema.fields]
    summed = source.mapInArrow(add, ", ".join([*kinds, "_n bigint", *(f"{s} double" for s in sums)]))
    total = F.sum("_n")
    return summed.groupBy(*by).agg(
        F.array(*[F.sum(s) / total for s in sums[:d]]).alias("m"), F.array(*[F.sum(s) / total for s in sums[d:]]).alias("p"))


def scoped_components(scaled: DataFrame, names: list[str], features: tuple[str, ...], by: tuple[str, ...], k: int = 2) -> ScopedComponents:
    """Components of every scope: one grouped aggregation, then one small matrix per row."""

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [leading(_matrix(m, p), k) for m, p in zip(frame["m"], frame["p"])]
            yield frame[list(by)].assign(loadings=[[list(w) for w in x[0]] for x in found], ratios=[list(x[1]) for x in found])

    moments = _scoped_moments(scaled, names, by)
    keys = ", ".join(f"`{n}` {t}" for n, t in moments.select(*by).dtypes)
    rows = moments.mapInPandas(solved, f"{keys}, loadings array<array<double>>, ratios array<double>")
    return ScopedComponents(tuple(features), by, k, materialize(rows, "components"))

"""Nearest-centre arithmetic and a DataFrame Lloyd iteration, keyed or not.

A step is one scan of the stored features; only partial sums per cluster are
shuffled.  Few scopes (checked) are measured over blocks (``blocks``); for many, distances are written out as sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.operators import blocks
from packetweave.operators.scaling import Terms, with_z, z_names
from packetweave.storage import in_driver, is_small, materialize

CENTRE_PLACES = 9
# Of the trainers that run to convergence; packets within this squared distance of a centre are the same point.
TOLERANCE, MOST_STEPS = 1e-4, 300
SAME_POINT, COST_PLACES = 1e-12, 6


TRAINED = "means array<double>, scales array<double>, centres array<array<double>>"


def start_position(total: int, k: int, i: int) -> int:
    """1-based position of start row ``i``; start rows spread over the capture."""
    return math.floor((i + 0.5) * total / k) + 1


def nearest(scaled: DataFrame, terms: Terms, keep: list[str]) -> DataFrame:
    """Add ``cluster_id`` (lowest id on ties), ``distance`` and squares ``_d0.._dk-1``."""
    squares = [f"_d{i}" for i in range(len(terms.centres))]
    measured = scaled.selectExpr(
        *keep,
        *[
            " + ".join(f"(z{j + 1} - {c}) * (z{j + 1} - {c})" for j, c in enumerate(centre)) + f" as {name}"
            for name, centre in zip(squares, terms.centres)
        ],
    )
    least = f"least({', '.join(squares)})" if len(squares) > 1 else squares[0]
    chosen = " ".join(f"when {name} = _least then {i}" for i, name in enumerate(squares))
    return measured.selectExpr("*", f"{least} as _least").selectExpr(
        *keep, *squares, f"case {chosen} end as cluster_id", "sqrt(_least) as distance"
    )


def _cluster_means(features: DataFrame, names: tuple[str, ...], terms: Terms, small: bool | None = None) -> DataFrame:
    """One step: ``(*by, cluster_id, centre)`` with rounded means."""
    z = z_names(len(names))
    placed = terms.place(features, small)
    scaled = with_z(placed, names, terms, [*terms.by, *terms.columns()])
    assigned = nearest(scaled, terms, [*terms.by, *z])
    means = assigned.groupBy(*terms.by, "cluster_id").agg(*[F.expr(f"avg({c})").alias(c) for c in z])
    centre = "array(" + ", ".join(f"round({c}, {CENTRE_PLACES})" for c in z) + ")"
    return means.select(*terms.by, "cluster_id", F.expr(centre).alias("centre"))


def lloyd(
    features: DataFrame,
    names: tuple[str, ...],
    start: DataFrame,
    by: tuple[str, ...],
    k: int,
    iterations: int,
    limit: int | None = None,
) -> DataFrame:
    """Run Lloyd steps; ``start`` holds keys, ``means``, ``scales``, ``centres``.

    A cluster that loses all rows keeps its centre.  Stops early once no centre
    of any scope moves.  Returns frozen scope rows with the final ``centres``.
    """
    if by:
        return _lloyd_keyed(features, names, start, by, k, iterations, limit)
    row = start.first()
    centres = list(row["centres"])
    for _ in range(iterations):
        held = [{"means": row["means"], "scales": row["scales"], "centres": centres}]
        # k rows come back, whatever the input size.
        found = {r["cluster_id"]: r["centre"] for r in blocks.cluster_means(features, names, held, (), k, CENTRE_PLACES).collect()}
        stepped = [found.get(i, centres[i]) for i in range(k)]
        if stepped == centres:
            break
        centres = stepped
    return start.sparkSession.createDataFrame([(row["means"], row["scales"], centres)], start.schema)


def _lloyd_keyed(
    features: DataFrame, names: tuple[str, ...], start: DataFrame, by: tuple[str, ...], k: int,
    iterations: int, limit: int | None,
) -> DataFrame:
    """All scopes step together, in one job per step.

    Between steps the centres of few scopes (checked) stay with the driver,
    those of many scopes in a table.
    """
    rows = start
    small = is_small(rows, limit)
    for _ in range(iterations):
        if small:
            means = blocks.cluster_means(features, names, rows.collect(), by, k, CENTRE_PLACES)
        else:
            means = _cluster_means(features, names, Terms.of(rows, by, len(names), k), small)
        found = means.groupBy(*by).agg(
            F.map_from_entries(F.collect_list(F.struct("cluster_id", "centre"))).alias("_found")
        )
        stepped = rows.join(found, list(by), "left").withColumn(
            "_next", F.expr("transform(centres, (c, i) -> coalesce(try_element_at(_found, i), c))")
        )
        stepped = stepped.select(
            *by, "means", "scales", F.col("_next").alias("centres"), (F.col("_next") != F.col("centres")).alias("_moved")
        )
        rows = in_driver(stepped) if small else materialize(stepped, "centres")
        still = rows.filter("_moved").isEmpty()
        rows = rows.drop("_moved")
        if still:
            break
    return rows

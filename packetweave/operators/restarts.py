"""K-means with several seeded starts, run to convergence, for the whole input or per capture.

Start centres are drawn with weights of squared distance: every packet races with
an exponential key, -ln(u) / d^2, u hashed from seed, run, step and packet number, and
the smallest key wins, so a draw is one partial minimum.  All runs of all scopes
share each scan; those that moved by no more than ``TOLERANCE`` in all drop out of the
next ones.  The cheapest run of a scope stays, the earlier one where costs agree to
``COST_PLACES``.  Few scopes (checked) go over stored blocks of packets (``scoped``), many through tables.

Scopes with fewer distinct packets than centres get null for the centres that
cannot be drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave.operators import blocks, scoped
from packetweave.operators.kmeans import CENTRE_PLACES, COST_PLACES, MOST_STEPS, SAME_POINT, TOLERANCE, nearest
from packetweave.operators.scaling import Terms, with_z, z_names
from packetweave.storage import attach, in_driver, is_small, materialize

RUN = "_run"


def uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1], from 52 bits of MD5, which any engine can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)


def _per_run(stored: DataFrame, names: tuple[str, ...], rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Number and features of each packet, once per run of its scope; for few scopes (checked)."""
    placed = attach(stored.select(*by, "packet_number", *names), rows.select(*by, RUN), by, spread="packet_number", small=True)
    return placed.filter(F.col(RUN).isNotNull())


def _measured(stored: DataFrame, names: tuple[str, ...], rows: DataFrame, by: tuple[str, ...], centres: int, small: bool) -> DataFrame:
    """Each packet once per run of its scope: keys, number, ``z1..zd`` (of many scopes only), and with centres label and distance."""
    keys = [*by, RUN]
    if small and centres:
        near = blocks.labelled(_per_run(stored, names, rows, by), names, rows.collect(), tuple(keys), centres)
        return near.select("packet_number", *keys, "cluster_id", "distance")
    terms = Terms.of(rows, tuple(keys), len(names), centres)
    placed = attach(stored, terms.rows, by, spread="packet_number", small=small).filter(F.col(RUN).isNotNull())
    kept = ["packet_number", *keys]
    scaled = with_z(placed, names, terms, [*kept, *terms.columns()])
    return nearest(scaled, terms, [*kept, *z_names(len(names))]) if centres else scaled


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left")


def drawn_starts(stored: DataFrame, names: tuple[str, ...], rows: DataFrame, by: tuple[str, ...], k: int, seed: int) -> DataFrame:
    """``rows`` (keys, run, means, scales, centres) with ``k`` drawn centres."""
    keys, numbers = [*by, RUN], range(len(names))
    scaled = ", ".join(f"round((cast(`{n}` as double) - means[{j}]) / scales[{j}], {CENTRE_PLACES})" for j, n in zip(numbers, names, strict=True))
    for step in range(k):
        race = -F.log(uniform(seed, F.col(RUN), F.lit(step), F.col("packet_number")))
        found = _measured(stored, names, rows, by, step, False)
        if step:
            squared = F.col("distance") * F.col("distance")
            race = F.when(squared > SAME_POINT, race / squared)
        # Numbers only, so that the minimum is a hash aggregate; the drawn packets are fetched after it.
        drawn = found.select(*keys, "packet_number", race.alias("_key")).groupBy(*keys).agg(F.min_by("packet_number", "_key").alias("packet_number"))
        drawn = materialize(drawn.filter("packet_number is not null"), "drawn")
        picked = stored.select(*by, "packet_number", *names).join(drawn, [*by, "packet_number"])
        picked = _same(picked, rows, keys).select(*keys, F.expr(f"array({scaled})").alias("_picked"))
        rows = materialize(_same(rows, picked, keys).select(
            *keys, "means", "scales", F.concat("centres", F.array("_picked")).alias("centres")), "starts")
    return rows


def _shift(found: str) -> str:
    """Summed squared movement of the centres that have packets."""
    gap = "aggregate(zip_with(n, c, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)"
    each = f"zip_with({found}, centres, (n, c) -> coalesce({gap}, 0D))"
    return f"aggregate({each}, 0D, (s, x) -> s + x)"


def converged(stored: DataFrame, names: tuple[str, ...], rows: DataFrame, by: tuple[str, ...], k: int, steps: int = MOST_STEPS) -> DataFrame:
    """Steps of all runs together, a table per step; a centre without packets stays where it is."""
    keys, z = [*by, RUN], z_names(len(names))
    rows = rows.withColumn("_moving", F.lit(True))
    for _ in range(steps):
        near = _measured(stored, names, rows.filter("_moving").drop("_moving"), by, k, False)
        means = near.groupBy(*keys, "cluster_id").agg(F.array(*[F.round(F.avg(c), CENTRE_PLACES) for c in z]).alias("centre"))
        found = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "centre"))).alias("_found"))
        after = _same(rows, found, keys).withColumn(
            "_next", F.expr("transform(centres, (c, i) -> coalesce(try_element_at(_found, i), c))"))
        rows = materialize(after.select(
            *keys, "means", "scales", F.col("_next").alias("centres"),
            (F.col("_moving") & (F.expr(_shift("_next")) > TOLERANCE)).alias("_moving")), "centres")
        if rows.filter("_moving").isEmpty():
            break
    return rows.drop("_moving")


def cheapest(stored: DataFrame, names: tuple[str, ...], rows: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    """The run of each scope with the smallest summed squared distance."""
    keys = [*by, RUN]
    near = _measured(stored, names, rows, by, k, False)
    costs = near.groupBy(*keys).agg(F.round(F.sum(F.col("distance") * F.col("distance")), COST_PLACES).alias("_cost"))
    best = rows.join(costs, keys).groupBy(*by).agg(F.min_by(F.struct("means", "scales", "centres"), F.struct("_cost", RUN)).alias("_best"))
    return best.select(*by, "_best.*")


def restarted(
    stored: DataFrame, names: tuple[str, ...], scale: DataFrame, by: tuple[str, ...], k: int,
    restarts: int, seed: int, limit: int | None = None, steps: int = MOST_STEPS,
) -> DataFrame:
    """Scope rows with ``means, scales, centres``; ``scale`` has keys, means and scales."""
    none = F.array().cast("array<array<double>>")
    rows = scale.select(*by, F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias(RUN), "means", "scales", none.alias("centres"))
    rows = materialize(rows, "runs") if by else in_driver(rows)
    if not by or is_small(rows, limit):
        trained = rows.filter(F.col(RUN) == 0).drop(RUN)
        best = scoped.trained(stored, names, trained.collect(), by, k, restarts, seed, steps)
        return trained.sparkSession.createDataFrame(best, trained.schema)
    rows = drawn_starts(stored, names, rows, by, k, seed)
    rows = converged(stored, names, rows, by, k, steps)
    return materialize(cheapest(stored, names, rows, by, k), "trained")

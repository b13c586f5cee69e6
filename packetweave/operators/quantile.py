"""Exact linear-interpolated quantiles by range counts.

Each round counts the values of a scope in equal bins between the ends of its
bracket, with partial sums, and keeps the bin that holds the wanted rank; the
bin's own smallest and largest values are the next bracket.  A scope is done when
these are equal, or when the two ranks to interpolate between fall into different bins.  No
task holds more than ``BINS`` rows of a scope, whatever its size, and a scope that
holds most of the data is counted by all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetweave.functions.numbers import interpolate
from packetweave.storage import attach, freeze

BINS = 4096


def _brackets(data: DataFrame, value: str, q: float, by: tuple[str, ...]) -> DataFrame:
    """Per scope: n, the ends of all values, and the 1-based ranks around the quantile."""
    rows = data.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    place = F.lit(q) * (F.col("n") - 1)
    return rows.select(
        *by, "n", "_low", "_high", (F.floor(place) + 1).alias("_first"), (F.ceil(place) + 1).alias("_second"),
        (place - F.floor(place)).alias("_fraction"), F.lit(0).cast("bigint").alias("_below"))


def _narrowed(data: DataFrame, value: str, open_rows: DataFrame, by: tuple[str, ...], spread: str, bins: int) -> DataFrame:
    """The same rows with the bracket shrunk to the bins of their ranks."""
    v, low, high = F.col(value), F.col("_low"), F.col("_high")
    # Halves first: the width of a bracket may be beyond the largest double.
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    counted = (
        attach(data, open_rows.select(*by, "_low", "_high"), by, spread=spread)
        .filter((v >= low) & (v <= high) & (low < high))
        .groupBy(*by, F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_least"), F.max(value).alias("_most"))
    )
    # At most ``bins`` rows per scope from here on.
    upto = F.sum("_rows").over(Window.partitionBy(*by).orderBy("_bin"))
    ranked = counted.withColumn("_upto", upto)
    placed = ranked.join(open_rows, list(by)) if by else ranked.crossJoin(F.broadcast(open_rows))
    holds = lambda rank: (F.col("_upto") + F.col("_below") >= rank) & (F.col("_upto") - F.col("_rows") + F.col("_below") < rank)
    one, other = holds(F.col("_first")), holds(F.col("_second"))
    kept = ["n", "_first", "_second", "_fraction"]
    picked = placed.filter(one | other).groupBy(*by).agg(
        *[F.first(c).alias(c) for c in kept],
        # In different bins, the first rank is the largest of its bin and the second the smallest of its own.
        F.max(F.when(one, F.when(other, F.col("_least")).otherwise(F.col("_most")))).alias("_low"),
        F.max(F.when(other, F.when(one, F.col("_most")).otherwise(F.col("_least")))).alias("_high"),
        F.max(F.when(one, F.col("_below") + F.col("_upto") - F.col("_rows"))).alias("_below"),
        F.bool_or(one & other).alias("_open"),
    )
    return picked


def quantile_rows(
    df: DataFrame,
    value: str,
    q: float,
    by: tuple[str, ...] = (),
    name: str = "quantile",
    spread: str = "frame_number",
    bins: int = BINS,
) -> DataFrame:
    """Frozen rows ``(*by, n, name)`` with the exact quantile; null for no values.

    ``df`` needs ``by``, ``value`` and, when keyed, the ``spread`` column.
    """
    needed = list(dict.fromkeys([*by, value, *([spread] if by else [])]))
    data = df.select(*needed).filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    columns = [*by, "n", "_low", "_high", "_fraction"]
    rows = freeze(_brackets(data, value, q, by).withColumn("_open", F.col("_low") < F.col("_high")), by, "bracket")
    done = None
    while True:
        settled = rows.filter(~F.coalesce("_open", F.lit(False)) | (F.col("_low") == F.col("_high"))).select(columns)
        done = settled if done is None else done.unionByName(settled)
        still = rows.filter("_open and _low < _high")
        if still.isEmpty():
            break
        rows = freeze(_narrowed(data, value, still.drop("_open"), by, spread, bins), by, "bracket")
    return freeze(done.select(*by, "n", interpolate(F.col("_low"), F.col("_high"), F.col("_fraction")).alias(name)), by, "quantile")

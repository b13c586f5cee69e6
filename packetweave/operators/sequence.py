"""Row order across partitions: position in the capture and the previous value.

A ``lag`` over a whole capture would sort that capture in one task.  Here every
capture is cut into frame-number buckets; windows run inside a bucket, and a
small table with one row per bucket carries the row count and the last value
over to the next bucket that exists.  The carry join uses the same keys as the
window, so packet rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET_FRAMES = 1 << 16
SMALLEST, LARGEST = 1 << 10, 1 << 18


def bucket_for(total: int, spark: SparkSession) -> int:
    """Bucket width for a known row count: four buckets per core, within bounds."""
    return min(max(total // (4 * spark.sparkContext.defaultParallelism), SMALLEST), LARGEST)


def with_sequence(
    df: DataFrame,
    value: Column,
    by: tuple[str, ...] = (),
    order: str = "frame_number",
    bucket_frames: int = BUCKET_FRAMES,
    seed: DataFrame | None = None,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``packet_number`` (1-based position) and ``_previous`` (value before).

    ``value`` is a double; ``_previous`` is null on the first row of a scope
    and wherever the row before has no value.  ``seed`` continues an earlier
    part of the data: keys, ``seed_rows`` and ``seed_value``, one row per scope.
    ``within`` names the captures of a scope that holds several: positions run
    through them in order, values don't carry from one to the next, and each
    capture has buckets of its own.  Equal places are ordered by value.
    """
    place = F.coalesce(F.col(order), F.lit(0))
    staged = df.withColumn("_value", value).withColumn(
        "_bucket", F.expr(f"coalesce({order}, 0) div {bucket_frames}")
    )
    staged = staged.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in within})
    keys = [*by, *within, "_bucket"]
    edges = staged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.struct(place.alias("at"), "_value"))["_value"].alias("_tail")
    )
    # One row per bucket from here on: 1/65536 of the packets, or one per small capture.
    buckets = Window.partitionBy(*by).orderBy(*within, "_bucket")
    edges = edges.select(
        *keys,
        F.coalesce(
            F.sum("_rows").over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.lag("_tail").over(Window.partitionBy(*by, *within).orderBy("_bucket")).alias("_carried"),
    )
    if seed is not None:
        edges = edges.join(seed, list(by), "left") if by else edges.crossJoin(F.broadcast(seed))
        edges = edges.select(
            *keys,
            (F.col("_before") + F.coalesce("seed_rows", F.lit(0))).alias("_before"),
            F.when(F.col("_before") == 0, F.col("seed_value")).otherwise(F.col("_carried")).alias("_carried"),
        )

    inside = Window.partitionBy(*keys).orderBy(order, "_value")
    numbered = staged.select(
        "*",
        F.row_number().over(inside).alias("_position"),
        F.lag("_value").over(inside).alias("_lagged"),
    )
    return (
        numbered.join(edges, keys, "left")
        .withColumn("packet_number", F.col("_before") + F.col("_position"))
        .withColumn("_previous", F.when(F.col("_position") == 1, F.col("_carried")).otherwise(F.col("_lagged")))
        .drop("_bucket", "_position", "_lagged", "_before", "_carried", "_value")
    )


def delta(value: Column) -> Column:
    """Difference to the previous row; 0 where either side is missing."""
    return F.coalesce(value - F.col("_previous"), F.lit(0.0))

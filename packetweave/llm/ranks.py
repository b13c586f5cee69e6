"""Dense positions of rows in a global order, without one task for any group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetweave.storage import materialize


def ranked(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], label: str, name: str = "rank") -> DataFrame:
    """Adds the 0-based position within ``by`` in the order of ``order``, nulls first.

    Rows are dealt out by ranges of both, so a group of any size spreads over tasks;
    ``order`` should tell rows apart, or equal ones meet in one task.  The window runs
    over one row per group and partition.
    """
    keys = [*by, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    stored = materialize(placed, label).withColumn("_part", F.expr("shiftright(_id, 33)"))
    parts = stored.groupBy(*by, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"), f"{label}-starts")
    same = stored["_part"] == starts["_part"]
    for c in by:
        same = same & stored[c].eqNullSafe(starts[c])
    return stored.join(starts, same).select(
        *(stored[c] for c in rows.columns), (stored["_id"] - starts["_first"] + starts["_before"]).alias(name))

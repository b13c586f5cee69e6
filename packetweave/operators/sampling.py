"""Exact-size reproducible sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave import schema as S


def draw_key(columns: list[str], seed: int) -> Column:
    """52 bits of a seeded md5 as a number, the same in every engine."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def sample_exact(df: DataFrame, size: int, columns: list[str], seed: int = S.DEFAULT_SEED) -> DataFrame:
    """``size`` rows with the smallest draw keys; all rows when there are fewer.

    The cut-off key is found by counting keys in equal ranges and narrowing to
    the range that holds the last wanted row, so no task sorts the whole input
    and the sample itself stays distributed.
    """
    keyed = df.withColumn("_draw", draw_key(columns, seed))
    low, high, taken = 0, 1 << 52, 0
    while high - low > 1:
        width = max((high - low) // 4096, 1)
        bins = (
            keyed.filter((F.col("_draw") >= low) & (F.col("_draw") < high))
            .groupBy(F.floor((F.col("_draw") - low) / F.lit(width)).alias("_bin"))
            .agg(F.count(F.lit(1)).alias("_rows"))
        )
        # At most 4097 rows come back per round.
        counts = sorted((int(r["_bin"]), r["_rows"]) for r in bins.collect())
        if low == 0 and high == 1 << 52 and sum(c for _, c in counts) <= size:
            return df
        for index, rows in counts:
            if taken + rows >= size:
                low, high = low + index * width, min(low + (index + 1) * width, high)
                break
            taken += rows
        if taken + rows == size:
            return keyed.filter(F.col("_draw") < high).drop("_draw")
        if rows <= 100_000:
            break
    inside = keyed.filter((F.col("_draw") >= low) & (F.col("_draw") < high))
    last = inside.orderBy("_draw", *columns).limit(size - taken)
    return keyed.filter(F.col("_draw") < low).unionByName(last).drop("_draw")

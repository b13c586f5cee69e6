"""Top-n rows, per scope or overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: tuple[str, ...], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every scope with a 1-based rank.

    With keys, Spark prunes each task to ``n`` rows per key before the shuffle
    (window group limit).  Without keys, the ``limit`` is a distributed top-k
    and only its ``n`` rows are numbered.
    """
    if not by:
        df = df.orderBy(*order).limit(n)
    place = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(place)).filter(F.col(rank) <= n)


def value_counts(df: DataFrame, by: tuple[str, ...], column: str) -> DataFrame:
    """Packets per value, missing values left out."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(*by, column)
        .agg(F.count(F.lit(1)).alias("packets"))
    )


def most_frequent_first(column: str) -> list[Column]:
    return [F.desc("packets"), F.asc(column)]

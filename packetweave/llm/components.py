"""Connected components of links, by alternating large and small stars.

Links and labels stay distributed.  Each step takes the smallest neighbour of
every node by partial aggregation and joins it to the links from written
tables, so that a hub's links can be split over tasks.  Rounds are logarithmic
in practice, also for long chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.storage import materialize


def _star(links: DataFrame, label: str) -> DataFrame:
    """(u, v, least): each link with the smallest of u and its neighbours."""
    least = materialize(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")), f"{label}-least")
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = materialize(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links-both")
    far = _star(both, "large").filter("v > u")
    return far.select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links-down")
    near = _star(down, "small")
    return near.select(F.col("v").alias("u"), F.col("least").alias("v")).union(near.select("u", F.col("least").alias("v"))).filter("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes of the links (u, v)."""
    links = materialize(links.filter("u <> v"), "links")
    before, now = None, _mark(links)
    while before != now:
        links = materialize(_small_star(materialize(_large_star(links), "links-large")), "links-small")
        before, now = now, _mark(links)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

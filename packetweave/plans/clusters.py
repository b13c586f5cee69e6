"""Cluster profiles from the labelled packets of an analysis.

``labelled`` frames carry ``cluster_id`` next to the kept packet columns; every
report is one aggregation with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.functions.text import packet_line
from packetweave.operators import ranking
from packetweave.plans.analysis import Analysis


def cluster_lengths(labelled: DataFrame, by: tuple[str, ...] = (), length: str = "length") -> DataFrame:
    """Mean and maximum length; missing lengths are left out."""
    return labelled.groupBy(*by, "cluster_id").agg(
        F.count(F.lit(1)).alias("packets"),
        F.avg(length).alias("avg_length"),
        F.max(length).alias("max_length"),
    )


def cluster_protocols(labelled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Packets and error packets per cluster and protocol."""
    return (
        labelled.filter(F.col("protocol").isNotNull())
        .groupBy(*by, "cluster_id", "protocol")
        .agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("has_error").cast("bigint")).alias("error_packets"))
    )


def cluster_top(analysis: Analysis, n: int = 3) -> DataFrame:
    """Top protocols, sources and destinations per cluster, percent of the cluster.

    Grouping sets count all three dimensions in one scan; the window keeps n
    rows per task and group before its shuffle.
    """
    by = analysis.by
    kinds = ["protocol", "src_ip", "dst_ip"]
    fixed = [*by, "cluster_id"]
    grouped = analysis.packets.groupingSets([[*fixed, c] for c in kinds], *fixed, *kinds).agg(
        F.count(F.lit(1)).alias("packets"), F.grouping_id().alias("_set")
    )
    codes = {c: (1 << len(kinds)) - 1 - (1 << (len(kinds) - 1 - i)) for i, c in enumerate(kinds)}
    kind = F.coalesce(*[F.when(F.col("_set") == code, F.lit(c)) for c, code in codes.items()])
    item = F.coalesce(*[F.when(F.col("_set") == code, F.col(c)) for c, code in codes.items()])
    counts = grouped.select(*fixed, kind.alias("kind"), item.alias("item"), "packets").filter("item is not null")
    best = ranking.top_n(counts, (*fixed, "kind"), ranking.most_frequent_first("item"), n)
    sizes = analysis.cluster_sizes().select(*fixed, F.col("packets").alias("_size"))
    return best.join(F.broadcast(sizes) if not by else sizes, fixed, "left").select(
        *fixed, "kind", "rank", "item", "packets", (F.col("packets") * 100.0 / F.col("_size")).alias("percent")
    )


def cluster_samples(labelled: DataFrame, by: tuple[str, ...] = (), n: int = 2, length: str = "length") -> DataFrame:
    """First ``n`` packets of every cluster in capture order, as text lines."""
    first = ranking.top_n(labelled, (*by, "cluster_id"), [F.asc("packet_number")], n)
    line = packet_line(
        F.col("protocol"), F.col("src_ip"), F.col("dst_ip"), F.col(length), F.col("info"), 50
    )
    return first.select(*by, "cluster_id", "rank", "packet_number", line.alias("line"))


def cluster_profile(analysis: Analysis, length: str = "length") -> DataFrame:
    """One row per cluster: size, share, lengths, errors, top values and samples."""
    by, labelled = analysis.by, analysis.packets
    keys = [*by, "cluster_id"]
    sizes = analysis.cluster_sizes()
    lengths = cluster_lengths(labelled, by, length).drop("packets")
    tops = cluster_top(analysis).groupBy(*keys).agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "item", "packets", "percent")))).alias(f"top_{kind}")
            for kind in ("protocol", "src_ip", "dst_ip")
        ]
    )
    samples = cluster_samples(labelled, by, length=length).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("samples")
    )
    return sizes.join(lengths, keys, "left").join(tops, keys, "left").join(samples, keys, "left")

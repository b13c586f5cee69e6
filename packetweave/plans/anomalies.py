"""Anomaly reports: small clusters, long packets, errors, scores, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave import schema as S
from packetweave.functions.text import packet_line, score_band
from packetweave.operators import ranking
from packetweave.operators.quantile import quantile_rows
from packetweave.plans.analysis import Analysis
from packetweave.storage import attach, freeze


def small_clusters(analysis: Analysis) -> DataFrame:
    """Clusters under 5 % of their scope, smallest first."""
    rows = analysis.cluster_sizes().filter("is_small")
    return rows.select(*analysis.by, "cluster_id", "packets", "percent").orderBy(*analysis.by, "packets", "cluster_id")


def _small_ids(analysis: Analysis) -> DataFrame:
    """Scope rows with the ids of small clusters: at most k per scope."""
    ids = F.filter(
        F.transform("sizes", lambda n, i: F.when(
            (n > 0) & (n < F.col("total") * S.SMALL_CLUSTER_SHARE), i.cast("int"))),
        lambda i: i.isNotNull(),
    )
    return analysis.model.select(*analysis.by, ids.alias("small_ids"))


def in_small_cluster(analysis: Analysis) -> DataFrame:
    """Labelled packets that belong to small clusters."""
    placed = attach(analysis.packets, _small_ids(analysis), analysis.by)
    return placed.filter(F.array_contains("small_ids", F.col("cluster_id"))).drop("small_ids")


def cluster_members(analysis: Analysis, cluster_id: int) -> DataFrame:
    return analysis.packets.filter(F.col("cluster_id") == cluster_id)


def high_anomalies(analysis: Analysis) -> DataFrame:
    return analysis.scored().filter("is_anomaly")


def long_packets(
    packets: DataFrame, by: tuple[str, ...] = (), length: str = "length", q: float = S.LONG_PACKET_QUANTILE
) -> DataFrame:
    """Packets strictly longer than the exact quantile, with the threshold."""
    cut = quantile_rows(packets, length, q, by, name="length_threshold").drop("n")
    return attach(packets, cut, by).filter(F.col(length) > F.col("length_threshold"))


def error_packets(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("has_error") == 1)


def first_lines(
    packets: DataFrame, by: tuple[str, ...] = (), n: int = 3, width: int = 50, length: str | None = "length"
) -> DataFrame:
    """Text lines of the first ``n`` packets in capture order."""
    first = ranking.top_n(packets, by, [F.asc("packet_number")], n)
    line = packet_line(
        F.col("protocol"), F.col("src_ip"), F.col("dst_ip"),
        F.col(length) if length else None, F.col("info"), width,
    )
    return first.select(*by, "rank", "packet_number", line.alias("line"))


def small_cluster_samples(analysis: Analysis, length: str = "length", n: int = 3) -> DataFrame:
    """Text lines of the first ``n`` packets of each small cluster; needs the text kept."""
    return first_lines(in_small_cluster(analysis), (*analysis.by, "cluster_id"), n, length=length)


def reasons(analysis: Analysis, protocol: Column | None = None) -> DataFrame:
    """Every packet with its anomaly reasons; needs ``protocol`` and ``has_error`` kept.

    Per-scope facts (small cluster ids, common protocols, score range) are
    bounded arrays in one scope row.  A protocol is rare when it is not among
    the at most 100 that reach 1 % of the scope; where none does, all are.
    """
    by = analysis.by
    name = F.coalesce(protocol if protocol is not None else F.col("protocol"), F.lit("unknown"))
    rows = analysis.model.select(*by, "common", "score_min", "score_max", "cut")
    small = _small_ids(analysis)
    rows = rows.join(small, list(by)) if by else rows.crossJoin(F.broadcast(small))
    placed = attach(analysis.packets, freeze(rows, by, "reasons"), by)
    low, high = F.col("score_min"), F.col("score_max")
    score = F.when(high > low, (F.col("distance") - low) / (high - low)).otherwise(F.col("distance"))
    flagged = placed.select(
        *by, "packet_number", "cluster_id", score.alias("anomaly_score"),
        (F.col("distance") > F.col("cut")).alias("high_score"),
        F.array_contains("small_ids", F.col("cluster_id")).alias("small_cluster"),
        (~F.array_contains(F.coalesce("common", F.array().cast("array<string>")), name)).alias("rare_protocol"),
        (F.col("has_error") == 1).alias("error_flag"),
    )
    marks = ["high_score", "small_cluster", "rare_protocol", "error_flag"]
    listed = F.array_compact(F.array(*[F.when(F.col(m), F.lit(m)) for m in marks]))
    return flagged.withColumn("reasons", listed).withColumn("score_band", score_band(F.col("anomaly_score")))


def anomalous(analysis: Analysis) -> DataFrame:
    """Packets with at least one reason."""
    return reasons(analysis).filter("high_score or small_cluster or rare_protocol or error_flag")


def anomaly_report(analysis: Analysis, packets_length: str = "length") -> DataFrame:
    """Long form: small clusters with their protocols, long packets, error packets."""
    by, labelled = analysis.by, analysis.packets
    small = in_small_cluster(analysis)
    per_cluster = small.groupBy(*by, "cluster_id").agg(
        F.count(F.lit(1)).alias("packets"),
        F.avg(packets_length).alias("avg_length"),
        F.max(packets_length).alias("max_length"),
        F.sum(F.col("has_error").cast("bigint")).alias("error_packets"),
    ).select(
        *by, F.lit("small_cluster").alias("section"), F.col("cluster_id").cast("string").alias("item"),
        "packets", "avg_length", "max_length", "error_packets",
    )
    protocols = small.filter(F.col("protocol").isNotNull()).groupBy(*by, "cluster_id", "protocol").agg(
        F.count(F.lit(1)).alias("packets")
    ).select(
        *by, F.lit("small_cluster_protocol").alias("section"),
        F.concat(F.col("cluster_id").cast("string"), F.lit("/"), F.col("protocol")).alias("item"), "packets",
    )
    long = long_packets(labelled, by, packets_length).groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"), F.avg(packets_length).alias("avg_length"),
        F.max(packets_length).alias("max_length"), F.sum(F.col("has_error").cast("bigint")).alias("error_packets"),
    ).select(*by, F.lit("long_packets").alias("section"), F.lit("all").alias("item"),
             "packets", "avg_length", "max_length", "error_packets")
    errors = error_packets(labelled).groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"), F.avg(packets_length).alias("avg_length"),
        F.max(packets_length).alias("max_length"), F.sum(F.col("has_error").cast("bigint")).alias("error_packets"),
    ).select(*by, F.lit("error_packets").alias("section"), F.lit("all").alias("item"),
             "packets", "avg_length", "max_length", "error_packets")
    return (
        per_cluster.unionByName(protocols, allowMissingColumns=True)
        .unionByName(long).unionByName(errors)
    )

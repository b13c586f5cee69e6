"""Result sinks: packet rows as JSON lines or CSV, the summary as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetweave.plans.analysis import Analysis


def packet_results(analysis: Analysis) -> DataFrame:
    return analysis.scored().select(*analysis.by, "packet_number", "cluster_id", "anomaly_score", "is_anomaly")


def write_json(analysis: Analysis, folder: str) -> None:
    """``folder/packet_results`` (JSON lines) and ``folder/summary`` (one row per scope)."""
    packet_results(analysis).write.mode("overwrite").json(f"{folder}/packet_results")
    document = analysis.summary().select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("analysis_timestamp"),
        F.struct("*").alias("summary"),
    )
    document.write.mode("overwrite").json(f"{folder}/summary")


def write_csv(analysis: Analysis, folder: str) -> None:
    packet_results(analysis).write.mode("overwrite").option("header", True).csv(folder)


def write_packets_csv(packets: DataFrame, folder: str, quote_all: bool = True, extension: str = "csv", by: tuple[str, ...] = ()) -> None:
    """A packet list with the raw header, as the readers expect it."""
    writer = packets.write.mode("overwrite").option("header", True).option("quoteAll", quote_all)
    # Values are written as they are, blanks and line breaks at their ends too.
    writer = writer.option("escape", '"').option("extension", extension)
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.partitionBy(*by) if by else writer).csv(folder)


RESULTS = "packet_number bigint, cluster_id int, anomaly_score double, is_anomaly boolean"


def read_results(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exported packet rows, with a fixed schema and the keys of a keyed export."""
    keys = "".join(f"`{c}` string, " for c in by)
    return spark.read.schema(keys + RESULTS).json(f"{folder}/packet_results")


def score_cutoff(results: DataFrame, cutoff: float = 0.8) -> DataFrame:
    return results.filter(F.col("anomaly_score") > cutoff)

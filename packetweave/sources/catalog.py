"""Capture files as a catalogue, and facts per capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetweave import schema as S


def capture_catalog(
    spark: SparkSession,
    folder: str,
    max_depth: int | None = None,
    below_bytes: int | None = None,
    suffixes: list[str] | None = None,
) -> DataFrame:
    """Capture files under ``folder``, newest first, with ``below_limit`` for the usual size limit.

    All files are listed unless ``max_depth`` or ``below_bytes`` filter them.
    Only file metadata is read: the content column is pruned and the size
    filter is pushed into the listing.
    """
    wanted = suffixes or S.CAPTURE_SUFFIXES
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{" + ",".join(wanted) + "}")
        .option("recursiveFileLookup", max_depth is None or max_depth > 1)
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    if below_bytes is not None:
        found = found.filter(F.col("length") < below_bytes)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    inner = F.substring_index("path", root + "/", -1)
    depth = F.size(F.split(inner, "/"))
    listed = found.withColumn("depth", depth).withColumn("file_name", F.substring_index("path", "/", -1))
    listed = listed.withColumn("below_limit", F.col("length") < S.CAPTURE_LIMIT_BYTES)
    listed = listed.withColumn("suffix", F.lower(F.substring_index("file_name", ".", -1)))
    if max_depth is not None:
        listed = listed.filter(F.col("depth") <= max_depth)
    return listed.orderBy(F.desc("modificationTime"), F.asc("path"))


def latest_capture(spark: SparkSession, folder: str) -> DataFrame:
    """The newest pcap or pcapng file directly in ``folder``."""
    return capture_catalog(spark, folder, max_depth=1, below_bytes=None, suffixes=["pcap", "pcapng"]).limit(1)


def capture_counts(packets: DataFrame) -> DataFrame:
    """Packets per capture."""
    return packets.groupBy("capture_id").agg(F.count(F.lit(1)).alias("packets"))


def _stem(path: str) -> Column:
    """The path before the suffix, local paths written one way."""
    return F.regexp_replace(F.regexp_replace(F.col(path), "^file:/+", "/"), r"\.[^./]*$", "")


def capture_facts(catalog: DataFrame, packets: DataFrame) -> DataFrame:
    """File facts next to packet counts: of the list with the same path before the suffix, or where captures are no paths, the same name."""
    counts = capture_counts(packets).withColumn("_stem", _stem("capture_id"))
    by_path = counts.filter(F.col("capture_id").contains("/")).select(F.col("_stem").alias("_path_stem"), "capture_id", "packets")
    by_name = counts.filter(~F.col("capture_id").contains("/")).select(
        F.col("_stem").alias("_name_stem"), F.col("capture_id").alias("_named"), F.col("packets").alias("_named_packets"))
    found = catalog.withColumns({"_path_stem": _stem("path"), "_name_stem": _stem("file_name")})
    joined = found.join(by_path, "_path_stem", "left").join(by_name, "_name_stem", "left")
    return joined.withColumns({"capture_id": F.coalesce("capture_id", "_named"), "packets": F.coalesce("packets", "_named_packets")}).drop(
        "_path_stem", "_name_stem", "_named", "_named_packets")

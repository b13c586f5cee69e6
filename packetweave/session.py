"""A local session with the settings the jobs are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """Local mode: as many shuffle partitions as cores, small AQE partitions.

    On a cluster the defaults of adaptive execution suit; small local tables
    would otherwise be merged into one or two tasks.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("packetweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

"""Shared scratch tables and the size rule for broadcasts.

Intermediate tables that are read more than once are written as parquet in the
folder the cluster names in ``spark.checkpoint.dir``.  They outlive any
executor, stay columnar and cut the lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast scope table holds one row of bounded width per capture; beyond
# this many rows ``attach`` takes the salted join instead.
BROADCAST_ROWS = 20_000
SALTS = 32


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="packetweave-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/packetweave/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_driver(rows: DataFrame) -> DataFrame:
    """Evaluate rows of a known small number and keep them as a local relation."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), schema=rows.schema)


def freeze(rows: DataFrame, by: tuple[str, ...], label: str) -> DataFrame:
    """Evaluate scope rows now: one row in memory, or a table when keyed."""
    # No keys means a global aggregate, so there is exactly one row.
    return materialize(rows, label) if by else in_driver(rows)


def is_small(rows: DataFrame, limit: int | None = None) -> bool:
    """True when a frozen scope table is within the broadcast bound."""
    bound = BROADCAST_ROWS if limit is None else limit
    return rows.limit(bound + 1).count() <= bound


def attach(
    facts: DataFrame,
    rows: DataFrame,
    by: tuple[str, ...],
    spread: str = "frame_number",
    limit: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Put the scope row of each packet's scope next to the packet.

    Without keys ``rows`` is a single row, held by the driver once frozen.  With keys a checked-small table is
    broadcast.  A larger one is replicated over a salt and shuffle-joined, so
    that a capture holding much of the data spreads over ``SALTS`` tasks.
    Loops pass ``small`` to check the size once.
    """
    if not by:
        return facts.crossJoin(F.broadcast(rows))
    if is_small(rows, limit) if small is None else small:
        return facts.join(F.broadcast(rows), list(by), "left")
    salted = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread_facts = facts.withColumn(
        "_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)).cast("int")
    )
    return spread_facts.join(salted, [*by, "_salt"], "left").drop("_salt")



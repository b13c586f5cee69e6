"""Traffic summary of raw packets, before any feature work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.functions.numbers import as_double
from packetweave.operators import heavy, ranking
from packetweave.storage import attach


def _length(packets: DataFrame):
    return as_double(F.col("length"), dict(packets.dtypes)["length"])


def _clock(packets: DataFrame):
    return as_double(F.col("timestamp"), dict(packets.dtypes)["timestamp"])


def totals(packets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Packets, length statistics, duration and packet rate; one pass."""
    rows = packets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"),
        F.avg(_length(packets)).alias("avg_length"),
        F.min(_length(packets)).alias("min_length"),
        F.max(_length(packets)).alias("max_length"),
        (F.max(_clock(packets)) - F.min(_clock(packets))).alias("duration"),
    )
    return rows.withColumn("packet_rate", F.try_divide(F.col("packets").cast("double"), F.col("duration")))


def shares(packets: DataFrame, column: str, by: tuple[str, ...] = (), top: int | None = None) -> DataFrame:
    """Counts per value with percent of all rows, missing values left out.

    The denominator counts every row.  Counts combine before the shuffle, so a
    value that covers much of the input costs one row per task.
    """
    counts = ranking.value_counts(packets, by, column)
    if top is not None:
        counts = ranking.top_n(counts, by, ranking.most_frequent_first(column), top)
    total = packets.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    joined = counts.join(total, list(by), "left") if by else attach(counts, total, ())
    return joined.withColumn("percent", F.col("packets") * 100.0 / F.col("total")).drop("total")


def top_shares(packets: DataFrame, column: str, top: int = 5) -> DataFrame:
    """As ``shares`` with ``top``, for columns of very many values: from summaries per task, exact all the same."""
    found = heavy.top_values(packets, column, top).rows
    total = packets.agg(F.count(F.lit(1)).alias("total"))
    return attach(found, total, ()).withColumn("percent", F.col("packets") * 100.0 / F.col("total")).drop("total")


def traffic_summary(packets: DataFrame, by: tuple[str, ...] = (), top: int = 5) -> DataFrame:
    """All sections in long form: ``section, item, rank, packets, value``.

    One scan feeds the protocol, source and destination counts through
    grouping sets; the wide totals come from a second, narrow scan.
    """
    sections = {"protocol": None, "src_ip": top, "dst_ip": top}
    grouped = packets.groupingSets([[*by, c] for c in sections], *by, *sections).agg(
        F.count(F.lit(1)).alias("packets"), F.grouping_id().alias("_set")
    )
    # The grouping id has a zero bit for the column that is kept.
    width = len(sections)
    picked = {c: (1 << width) - 1 - (1 << (width - 1 - i)) for i, c in enumerate(sections)}
    kind = F.coalesce(*[F.when(F.col("_set") == code, F.lit(c)) for c, code in picked.items()])
    item = F.coalesce(*[F.when(F.col("_set") == code, F.col(c)) for c, code in picked.items()])
    counts = grouped.select(*by, kind.alias("section"), item.alias("item"), "packets").filter("item is not null")
    ranked = [
        ranking.top_n(
            counts.filter(F.col("section") != "protocol"), (*by, "section"),
            ranking.most_frequent_first("item"), top,
        ).select(*by, "section", "item", "packets"),
        counts.filter(F.col("section") == "protocol"),
    ]
    facts = totals(packets, by)
    listed = ranked[0].unionByName(ranked[1])
    total = facts.select(*by, F.col("packets").alias("_total"))
    listed = listed.join(total, list(by), "left") if by else attach(listed, total, ())
    listed = listed.select(
        *by, "section", "item", "packets", (F.col("packets") * 100.0 / F.col("_total")).alias("value")
    )
    measures = ["avg_length", "min_length", "max_length", "duration", "packet_rate"]
    entries = F.array(*[F.struct(F.lit(m).alias("item"), F.col(m).alias("value")) for m in measures])
    wide = facts.select(*by, "packets", F.explode(entries).alias("e")).select(
        *by, F.lit("totals").alias("section"), F.col("e.item").alias("item"), "packets", F.col("e.value").alias("value")
    )
    return listed.unionByName(wide)

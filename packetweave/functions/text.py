"""Text forms used in the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packet_line(
    protocol: Column, source: Column, target: Column, length: Column | None, info: Column, width: int
) -> Column:
    """``TCP a -> b (60 bytes): first characters...`` with nulls shown as ``nan`` and whole lengths without a point."""
    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("nan"))

    parts = [shown(protocol), F.lit(" "), shown(source), F.lit(" -> "), shown(target)]
    if length is not None:
        number = length.cast("double")
        whole = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
        parts += [F.lit(" ("), shown(whole), F.lit(" bytes)")]
    return F.concat(*parts, F.lit(": "), F.substring(F.coalesce(info, F.lit("")), 1, width), F.lit("..."))


def score_band(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.7, "medium").when(score.isNotNull(), "high")

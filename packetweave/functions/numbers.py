"""Tolerant number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(text: Column) -> Column:
    """Plain decimal or exponent text to double, anything else to null.

    The pattern keeps out what a cast alone would take (``1d``, ``NaN``,
    ``Infinity``); an exponent too large for a double becomes null as well.
    """
    value = F.when(text.rlike(_PLAIN_NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def as_double(column: Column, data_type: str) -> Column:
    """A numeric column as finite double, whatever the reader delivered."""
    if data_type == "string":
        return to_number(column)
    value = column.cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def interpolate(low: Column, high: Column, fraction: Column) -> Column:
    """Linear interpolation between two neighbouring order statistics."""
    return low + (high - low) * fraction

"""Names and keys for rows of tables with unknown further columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*names: str) -> Column:
    """128 bits of what these columns hold; nulls differ from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.octet_length(F.col(n).cast("string")).cast("string"), F.lit(":"), F.col(n).cast("string")), F.lit("-")) for n in names]
    return F.unhex(F.md5(F.concat(*parts)))

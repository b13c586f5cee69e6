"""Packet-list readers: quoted, basic and tolerant CSV to canonical packets."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from packetweave import schema as S
from packetweave.functions.numbers import to_number
from packetweave.operators.features import with_defaults
from packetweave.sources import lines as L
from packetweave.sources import records as R
from packetweave.storage import attach, materialize


class SourceError(ValueError):
    """The input is absent, empty or not a packet list."""


@dataclass(frozen=True)
class SchemaReport:
    missing: tuple[str, ...]

    @property
    def status(self) -> str:
        """``ok``; ``warn`` for one or two missing columns; ``reject`` for more."""
        return "ok" if not self.missing else "warn" if len(self.missing) < 3 else "reject"


def check_columns(columns: list[str]) -> SchemaReport:
    return SchemaReport(tuple(c for c in S.REQUIRED_COLUMNS if c not in columns))


def renamed(df: DataFrame) -> DataFrame:
    """Canonical names for the raw columns that are present."""
    return df.withColumnsRenamed({f"{k}": v for k, v in S.CANONICAL.items() if k in df.columns})


def numbered(df: DataFrame) -> DataFrame:
    """Line position in the capture as ``_line`` (1-based), without a data shuffle.

    Row ids grow inside a file split; a table with one row per split turns
    them into dense positions.  The lines are stored with their ids first, as
    another scan could cut the files differently.
    """
    ids = materialize(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    splits = materialize(
        ids.groupBy("capture_id", "_file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")),
        "splits",
    )
    # Records that were put together carry their place in the split.
    known = F.col("_place") if "_place" in df.columns else F.lit(None)
    before = Window.partitionBy("capture_id").orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file", "_split", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        ids.join(offsets, ["_file", "_split"], "left")
        .withColumn("_line", F.coalesce(known, F.col("_id") - F.col("_first")) + F.col("_offset") + 1)
        .drop("_id", "_first", "_offset")
    )


def _canonical(df: DataFrame, fill: bool) -> DataFrame:
    """Typed canonical columns; absent order columns come from the line position."""
    if "frame_number" not in df.columns or "timestamp" not in df.columns:
        df = numbered(df)
        if "frame_number" not in df.columns:
            df = df.withColumn("frame_number", F.col("_line").cast("string"))
        if "timestamp" not in df.columns:
            df = df.withColumn("timestamp", (F.col("_line") - 1).cast("string"))
        df = df.drop("_line")
    present = [c for c in S.CANONICAL.values() if c in df.columns]
    others = [c for c in df.columns if c not in present and c not in ("_file", "_split", "_place", "capture_id")]
    typed = {
        "frame_number": to_number(F.col("frame_number")).cast("long"),
        "timestamp": to_number(F.col("timestamp")),
        "length": to_number(F.col("length")) if "length" in present else None,
    }
    out = df.select(
        "capture_id", *[(typed[c] if c in typed else F.col(c)).alias(c) for c in present], *others
    )
    if fill:
        out = with_defaults(out)
        if "length" in present:
            out = out.na.fill({"length": 0.0})
    return out


@dataclass(frozen=True)
class PacketLists:
    """Canonical packets of the lists that could be read, and (file, capture_id, reason) of the others.

    ``files`` has what was decided about the odd files: latin1, overlong, closed, headed; ``header`` is that of all.
    """

    packets: DataFrame
    refused: DataFrame
    files: DataFrame
    header: str


def _odd_files(inspected: DataFrame) -> DataFrame:
    """Files that need more than one plain parse per line; usually none."""
    return inspected.filter(
        ~F.col("utf8") | (F.col("overlong") > 0) | (F.col("headers") != 1) | (F.col("breaks") > 0) | (F.col("returns") > 0))


def _put_together(
    spark: SparkSession, paths: str | list[str], capture_by: str, chosen: DataFrame, header: str, width: int, extended: bool, line_wise: bool,
) -> tuple[DataFrame, DataFrame]:
    """Records, with their place in the split, and one row per file of the chosen files.

    The first record of a file is its header, by place, not by text.  Files with a quote that
    never ends are cut at every line instead, as the tolerant read does with all.
    """
    raw = L.read_lines(spark, paths, capture_by, blanks=True)
    lines = materialize(L.apart(attach(raw, chosen.select("_file", F.lit(True).alias("_chosen")), ("_file",), spread="value").filter("_chosen").drop("_chosen")), "odd-lines")
    plain = lines.withColumn("number", F.lit(None).cast("long")).select("capture_id", "_file", "_split", "_id", "number", "value").filter(F.length(F.trim("value")) > 0)
    if line_wise:
        records, files = plain, lines.select("_file").distinct().withColumn("closed", F.lit(True))
    else:
        records, files = R.cut(lines, extended)
        files = materialize(files, "odd-closed")
        counts = records.groupBy("_file").agg(F.count_if(L.too_long(F.col("value"), width, extended)).alias("overlong"))
        files = materialize(files.join(counts, "_file", "left"), "odd-counted")
        if extended:
            # The tolerant read goes line by line, also through quotes.
            ragged = files.filter(~F.col("closed") | (F.col("overlong") > 0)).select("_file")
            records = records.join(ragged, "_file", "left_anti").union(plain.join(ragged, "_file"))
    stored = materialize(records, "odd-records")
    at = F.struct("_split", "_id")
    heads = stored.groupBy("_file").agg(F.min(at).alias("_head"), F.min_by("value", at).alias("_first"))
    files = materialize(files.join(heads, "_file").withColumn("headed", L.is_header(F.col("_first"), header)), "odd-heads")
    inside = Window.partitionBy("_file", "_split").orderBy("_id")
    body = stored.join(files.select("_file", "_head"), "_file").filter(at > F.col("_head"))
    body = body.select("capture_id", "_file", "_split", "value", (F.row_number().over(inside) - 1).cast("long").alias("_place"))
    return body, files.drop("_head", "_first")


def read_lists(
    spark: SparkSession,
    paths: str | list[str],
    profile: str = "extended",
    mode: str = "auto",
    capture_by: str = "file_path",
    header: str | None = None,
) -> PacketLists:
    """Canonical packets of one or many packet lists that share the header of the first one, or the given one.

    A capture is a file, named by its path, as files in different folders may
    have one name.  Only the first record of a file is taken for its header.  A
    file with another header, or one that the mode can't read, is listed in
    ``refused`` with the reason; the others are read.

    ``extended`` accepts doubled quotes and backslash escapes and fills missing
    values; ``basic`` accepts doubled quotes only and fills nothing.  Quoted fields
    may hold line breaks: files with such records are cut by ``records``.  ``mode``:

    - ``strict``: UTF-8, at most as many fields as the header has; a file with
      a longer row, or a quote that never ends, is refused;
    - ``tolerant``: split at line breaks, then at commas outside quotes, pad short and
      cut long rows, keep blanks as empty text;
    - ``auto``: one inspection pass finds the files that are not UTF-8 (read as
      ISO-8859-1) or that strict refuses (extended: read tolerantly; basic: refused).
    """
    if profile not in ("extended", "basic"):
        raise ValueError(f"unknown profile {profile!r}")
    if mode not in ("auto", "strict", "tolerant"):
        raise ValueError(f"unknown mode {mode!r}")
    extended = profile == "extended"
    try:
        raw = L.read_lines(spark, paths, capture_by)
    except AnalysisException as error:
        raise SourceError(f"no packet list at {paths}") from error
    header = header or L.header_text(raw)
    if header is None:
        raise SourceError(f"empty packet list at {paths}")
    quoted = next(csv.reader([header]))
    columns = [c.strip() for c in (header.split(",") if mode == "tolerant" else quoted)]
    report = check_columns(columns)
    if not extended and report.status == "reject":
        raise SourceError(f"not a packet list, missing {', '.join(report.missing)}")
    width = len(columns)

    odd = materialize(_odd_files(R.inspect(raw, header, width, extended)), "odd")
    # Few files as a rule, and the size of what goes to each task is checked by ``attach``.
    apart = odd.filter((F.col("headers") > 1) | (F.col("returns") > 0) | (F.lit(mode != "tolerant") & (F.col("breaks") > 0) & (F.col("headers") > 0)))
    facts = odd.select(
        "_file", "capture_id", (~F.col("utf8")).alias("latin1"), "overlong", F.lit(True).alias("closed"), (F.col("headers") > 0).alias("headed"))
    body = raw.filter(~L.is_header(F.col("value"), header)).withColumn("_place", F.lit(None).cast("long"))
    if not apart.isEmpty():
        again, files = _put_together(spark, paths, capture_by, apart, header, width, extended, mode == "tolerant")
        known = apart.select("_file", "capture_id", (~F.col("utf8")).alias("latin1"), F.col("overlong").alias("_by_line")).join(files, "_file")
        overlong = F.col("_by_line") if mode == "tolerant" else F.coalesce("overlong", F.lit(0).cast("long"))
        facts = facts.join(apart.select("_file"), "_file", "left_anti").unionByName(
            known.select("_file", "capture_id", "latin1", overlong.alias("overlong"), "closed", "headed"))
        body = attach(body, apart.select("_file", F.lit(True).alias("_apart")), ("_file",), spread="value").filter("_apart is null").drop("_apart")
        body = body.unionByName(again)
    facts = materialize(facts, "odd-facts")
    # Only the extended read has a tolerant second attempt.
    final = mode == "strict" or (mode == "auto" and not extended)
    reason = F.when(~F.col("headed"), f"another header than {header!r}")
    if final:
        reason = reason.when(F.col("overlong") > 0, F.concat(F.lit(f"rows with more than {width} fields: "), F.col("overlong").cast("string"), F.lit(" in "), F.col("_file")))
        reason = reason.when(~F.col("closed"), "a quote that never ends")
    refused = facts.select(F.col("_file").alias("file"), "capture_id", reason.alias("reason")).filter(F.col("reason").isNotNull())
    value, ragged = F.col("value"), F.lit(mode == "tolerant")
    if not facts.isEmpty():
        marks = facts.select("_file", "latin1", (~F.col("closed") | (F.col("overlong") > 0)).alias("ragged"), reason.isNotNull().alias("refused"))
        body = attach(body, marks, ("_file",), spread="value").filter(~F.coalesce("refused", F.lit(False)))
        if mode == "auto":
            value = F.when(F.col("latin1"), L.latin1(value)).otherwise(value)
            if extended:
                ragged = F.coalesce(F.col("ragged"), F.lit(False))
    strict = F.slice(L.strict_fields(value, width, extended), 1, width)
    tokens = F.array(*[F.lit(t) for t in S.NULL_TOKENS])
    strict = F.transform(strict, lambda f: F.when(~F.array_contains(tokens, f), f))
    if mode == "tolerant":
        fields = L.tolerant_fields(value, width)
    elif mode == "auto":
        fields = F.when(ragged, L.tolerant_fields(value, width)).otherwise(strict)
    else:
        fields = strict
    split = body.select("capture_id", "_file", "_split", "_place", fields.alias("_fields"))
    named = split.select(
        "capture_id", "_file", "_split", "_place", *[F.col("_fields")[i].alias(c) for i, c in enumerate(columns)]
    )
    return PacketLists(_canonical(renamed(named), fill=extended), refused, facts, header)


def read_packets(
    spark: SparkSession,
    paths: str | list[str],
    profile: str = "extended",
    mode: str = "auto",
    capture_by: str = "file_path",
) -> DataFrame:
    """The packets of ``read_lists``; a refused file is an error."""
    lists = read_lists(spark, paths, profile, mode, capture_by)
    refused = lists.refused.limit(3).collect()
    if refused:
        raise SourceError("; ".join(f"{r['file']}: {r['reason']}" for r in refused))
    return lists.packets


def contract(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The seven-column list from dissector fields, first entry of repeated fields.

    ``columns`` maps raw names to source columns; address fields can hold
    several comma-separated values, of which the first counts.
    """
    source = columns or {c: c for c in S.RAW_COLUMNS}
    repeated = {"Source", "Destination"}
    return df.select(*[
        (F.split(F.col(f"`{source[c]}`"), ",")[0] if c in repeated else F.col(f"`{source[c]}`")).alias(c)
        for c in S.RAW_COLUMNS
    ])


def require_packets(df: DataFrame, minimum: int = 1) -> DataFrame:
    """Raise when fewer than ``minimum`` packets are there."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise SourceError(f"{found} packets, {minimum} needed")
    return df

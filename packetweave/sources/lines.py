"""Text lines of packet lists and what one inspection pass finds out about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stand-ins (private-use characters) for escaped quote, comma and backslash, the
# separator of tolerant fields, and line breaks inside quotes, while a record is
# split into fields; text that holds one of them is marked first.
QUOTE, COMMA, SLASH, SEPARATOR, LINE, RETURN, MARK = (chr(0xE000 + i) for i in range(7))
STAND_INS = QUOTE + COMMA + SLASH + SEPARATOR + LINE + RETURN + MARK
BYTE_ORDER_MARK = "\ufeff"


def read_lines(spark: SparkSession, paths: str | list[str], capture_by: str = "file_path", blanks: bool = False) -> DataFrame:
    """``value``, ``capture_id`` and the file split of every line; without ``blanks``, of every non-blank line without its carriage return.

    A capture is a file (``file_path``, or ``file_name`` where names are unique) or, for lists written
    as part files, a ``folder`` whose files follow each other by name.
    """
    if capture_by == "folder":
        # No pattern: one that backtracks over the path would take longer than the line.
        capture = F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
    else:
        capture = F.col(f"_metadata.{capture_by}")
    text = F.col("value")
    if not blanks:
        text = F.when(text.endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(text)
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        text.alias("value"),
        capture.alias("capture_id"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
    )
    return lines if blanks else lines.filter(F.length(F.trim("value")) > 0)


def apart(lines: DataFrame) -> DataFrame:
    """Lines of ``read_lines(blanks=True)`` cut at single carriage returns too, with ``_id`` ascending in a split and the line ``end``."""
    whole = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    last = F.when(F.col("value").endswith("\r"), "\r\n").otherwise("\n")
    pieces = F.split("_whole", "\r")
    ended = F.transform(pieces, lambda p, i: F.struct(p.alias("value"), F.when(i == F.size(pieces) - 1, F.col("_last")).otherwise("\r").alias("end")))
    marked = lines.withColumns({"_whole": whole, "_last": last})
    cut = marked.select("capture_id", "_file", "_split", F.explode(ended).alias("_piece"))
    return cut.select("capture_id", "_file", "_split", "_piece.*", F.monotonically_increasing_id().alias("_id"))


def latin1(value: Column) -> Column:
    return F.decode(value.cast("binary"), "ISO-8859-1")


def without_mark(value: Column) -> Column:
    return F.ltrim(value, F.lit(BYTE_ORDER_MARK))


def is_header(value: Column, header: str) -> Column:
    """True for lines with the same names, quoted or not."""
    return F.translate(without_mark(value), '"', "") == header.replace('"', "")


def header_text(lines: DataFrame) -> str | None:
    """First line of the first file, without a byte-order mark."""
    row = lines.filter(F.col("_split") == 0).select("value").first()
    return row["value"].lstrip(BYTE_ORDER_MARK).split("\r")[0] if row else None


def marked(value: Column) -> Column:
    """Stand-ins that the text itself holds, written as a mark and a digit."""
    held = F.replace(value, F.lit(MARK), F.lit(MARK + "6"))
    for i, c in enumerate(STAND_INS[:-1]):
        held = F.replace(held, F.lit(c), F.lit(f"{MARK}{i}"))
    return F.when(value.rlike(f"[{STAND_INS}]"), held).otherwise(value)


def unmarked(field: Column) -> Column:
    shown = field
    for i, c in enumerate(STAND_INS):
        shown = F.replace(shown, F.lit(f"{MARK}{i}"), F.lit(c))
    return F.when(field.contains(MARK), shown).otherwise(field)


def breaks_hidden(value: Column) -> Column:
    """Line breaks of a record as stand-ins, as the field parser takes one line."""
    return F.when(value.rlike("[\n\r]"), F.translate(value, "\n\r", LINE + RETURN)).otherwise(value)


def escapes_hidden(value: Column) -> Column:
    """Backslash escapes replaced by stand-ins; other lines pass untouched."""
    hidden = F.replace(value, F.lit("\\\\"), F.lit(SLASH))
    hidden = F.replace(hidden, F.lit('\\"'), F.lit(QUOTE))
    hidden = F.replace(hidden, F.lit("\\,"), F.lit(COMMA))
    hidden = F.replace(hidden, F.lit("\\"), F.lit(""))
    return F.when(value.contains("\\"), hidden).otherwise(value)


def escapes_shown(field: Column) -> Column:
    return F.translate(field, QUOTE + COMMA + SLASH + LINE + RETURN, '",\\\n\r')


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parsed(value: Column, width: int, escapes: bool) -> Column:
    """The struct of ``width`` fields and ``overflow``, with stand-ins, from one parse."""
    names = [f"c{i}" for i in range(width)] + ["overflow"]
    kinds = ", ".join(f"{n} string" for n in names)
    hidden = once(marked(value), breaks_hidden)
    hidden = once(hidden, escapes_hidden) if escapes else hidden
    # One look at the line; most have nothing to hide.
    text = F.when(value.rlike(f"[{STAND_INS}\n\r\\\\]"), hidden).otherwise(value)
    return once(text, lambda one: F.from_csv(one, kinds, {"escape": '"', "mode": "PERMISSIVE"}))


def strict_fields(value: Column, width: int, escapes: bool) -> Column:
    """Fields by quoted-CSV rules: doubled quotes, optionally backslash escapes.

    Returns an array of ``width + 1`` strings; the last one is set only for
    rows with too many fields.
    """
    names = [f"c{i}" for i in range(width)] + ["overflow"]
    fields = once(_parsed(value, width, escapes), lambda row: F.array(*[row.getField(n) for n in names]))
    return F.transform(F.transform(fields, escapes_shown), unmarked)


def too_long(value: Column, width: int, escapes: bool) -> Column:
    """True for rows with more than ``width`` fields by the rules of ``strict_fields``."""
    return _parsed(value, width, escapes).getField("overflow").isNotNull()


def tolerant_fields(value: Column, width: int) -> Column:
    """Fields split at commas outside quotes; every quote mark is dropped.

    Text between quote marks sits at odd positions of the split on ``"``, so
    only commas at even positions separate fields.  Short rows are padded with
    empty text and long rows cut, as many as ``width`` fields.
    """
    pieces = F.transform(
        F.split(marked(value), '"'),
        lambda piece, i: F.when(i % 2 == 0, F.replace(piece, F.lit(","), F.lit(SEPARATOR))).otherwise(piece),
    )
    fields = F.split(F.array_join(pieces, ""), SEPARATOR)
    # The fields are found once, not once per field.
    cleaned = once(fields, lambda found: F.transform(found, lambda f, i: once(F.when(i == F.size(found) - 1, F.trim(f)).otherwise(f), unmarked)))
    return F.slice(F.concat(cleaned, F.array_repeat(F.lit(""), width)), 1, width)

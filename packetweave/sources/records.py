"""Records of quoted CSV whose fields hold line breaks, cut in parallel.

Whether a line break ends a record depends on the quotes before it, back to the start
of the file.  A line is a function of one state, outside or inside quotes: two
answers, one per state at its start, found without knowing which holds.  Such functions
compose: the state after many lines is that set by the last line with one answer for both
states, turned by the number of flips since.  So a running composition inside each file
split, another over one row per split, and their join give the state at every line;
no task reads more than one split, and records may span any number of splits.

Lines that are whole records stay where they are; only the lines of longer records meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetweave.sources.lines import escapes_hidden, is_header, once, too_long
from packetweave.storage import materialize

# Where a reader of quoted fields stands: before a field, inside quotes, after a quote inside quotes, in an unquoted field.
FRESH, QUOTED, AFTER_QUOTE, PLAIN = 0, 1, 2, 3


def _over_text(state: Column, piece: Column) -> Column:
    """The state after text without quotes."""
    return (
        F.when((state == QUOTED) | (piece == ""), state)
        .when(piece.endswith(","), FRESH).otherwise(PLAIN)
    )


def _over_quote(state: Column) -> Column:
    """The state after a quote mark: it opens a field, ends one, or is text in the middle of an unquoted one."""
    return F.when(state.isin(FRESH, AFTER_QUOTE), QUOTED).when(state == QUOTED, AFTER_QUOTE).otherwise(PLAIN)


def line_function(value: Column, escapes: bool) -> dict[str, Column]:
    """Is a reader inside quotes at the end of the line: if it was outside at the start (``opened``), if it was inside (``kept``).

    ``joined``: a backslash hides the line break itself (extended dialect only); the
    line after it counts as the start of a field.
    """
    text = escapes_hidden(value) if escapes else value

    def quoted(start: int) -> Callable[[Column], Column]:
        def at_end(pieces: Column) -> Column:
            rest, first = F.slice(pieces, 2, F.size(pieces)), _over_text(F.lit(start), pieces[0])
            return F.aggregate(rest, first, lambda s, piece: _over_text(_over_quote(s), piece)) == QUOTED

        return at_end

    ends = {}
    for name, start in (("opened", FRESH), ("kept", QUOTED)):
        # Without quotes nothing changes.
        ends[name] = F.when(value.contains('"'), once(F.split(text, '"'), quoted(start))).otherwise(F.lit(start == QUOTED))
    slashes = F.length(F.regexp_extract(value, r"(\\+)$", 1)) % 2 == 1
    ends["joined"] = F.when(value.endswith("\\"), slashes).otherwise(False) if escapes else F.lit(False)
    return ends


def inspect(lines: DataFrame, header: str, width: int, escapes: bool) -> DataFrame:
    """Per file, in one distributed pass with a map-side combine: valid UTF-8, rows with too many fields, lines equal to the
    header, lines at whose end a quote is open or the line break hidden, lines with single carriage returns."""
    def told(value: Column) -> Column:
        ends = line_function(value, escapes)
        return F.struct(
            F.is_valid_utf8(value).alias("utf8"), too_long(value, width, escapes).alias("overlong"), is_header(value, header).alias("header"),
            (ends["opened"] | ends["joined"]).alias("broken"), value.contains("\r").alias("returned"))

    # The facts of a line first, apart from the sums, which then stay short enough to be compiled.
    facts = lines.select("_file", "capture_id", once(F.col("value"), told).alias("told"))
    counted = {"overlong": "overlong", "headers": "header", "breaks": "broken", "returns": "returned"}
    return facts.groupBy("_file", "capture_id").agg(
        F.bool_and("told.utf8").alias("utf8"), *[F.count(F.when(F.col(f"told.{fact}"), 1)).alias(name) for name, fact in counted.items()])


def _composed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``after_out`` and ``after_in``: the state after this row if the first of its group starts outside, or inside."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    flipped = rows.withColumn("_flips", F.sum((F.col("opened") & ~F.col("kept")).cast("int")).over(upto))
    settled = F.when(F.col("opened") == F.col("kept"), F.struct(F.col(order).alias("at"), F.col("opened").alias("state"), "_flips"))
    since = flipped.withColumn("_set", F.max(settled).over(upto))
    turned = (F.col("_flips") - F.coalesce(F.col("_set._flips"), F.lit(0))) % 2 == 1
    after = lambda start: F.coalesce(F.col("_set.state"), F.lit(start)) != turned
    return since.withColumns({"after_out": after(False), "after_in": after(True)}).drop("_flips", "_set")


def cut(lines: DataFrame, escapes: bool) -> tuple[DataFrame, DataFrame]:
    """Records and one row per file from all lines (capture_id, _file, _split, _id, value, end) of some files.

    ``_id`` ascends inside a split.  Records have the text with its inner line breaks, the
    place of their first line (_split, _id) and their number in the file.  Per file
    ``closed`` is false where the last quote never ends.
    """
    told = line_function(F.col("value"), escapes)
    states = materialize(_composed(lines.withColumns(told), ["_file", "_split"], "_id"), "line-states")
    last = states.groupBy("_file", "_split").agg(F.max_by("after_out", "_id").alias("opened"), F.max_by("after_in", "_id").alias("kept"))
    by_file = Window.partitionBy("_file").orderBy("_split")
    # One row per split.
    starts = _composed(last, ["_file"], "_split").withColumn("inside", F.lag("after_out", 1, False).over(by_file))
    starts = materialize(starts.select("_file", "_split", "inside", F.col("after_out").alias("left_inside")), "split-starts")
    placed = states.join(starts.select("_file", "_split", "inside"), ["_file", "_split"])
    inside = F.when(F.col("inside"), F.col("after_in")).otherwise(F.col("after_out"))
    placed = placed.withColumn("ends", ~inside & ~F.col("joined"))
    ended = placed.groupBy("_file", "_split").agg(F.count_if("ends").alias("_ended"), F.max_by("ends", "_id").alias("_whole"))
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    counts = ended.select(
        "_file", "_split", F.coalesce(F.sum("_ended").over(before), F.lit(0)).alias("_earlier"), F.lag("_whole", 1, True).over(by_file).alias("_fresh"))
    line = Window.partitionBy("_file", "_split").orderBy("_id")
    joined = placed.join(materialize(counts, "split-records"), ["_file", "_split"])
    joined = (
        joined.withColumn("number", F.col("_earlier") + F.coalesce(F.sum(F.col("ends").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("whole", F.col("ends") & F.coalesce(F.lag("ends").over(line), F.col("_fresh")))
    )
    names = ["capture_id", "_file", "_split", "_id", "number", "value"]
    parts = joined.filter(~F.col("whole")).groupBy("capture_id", "_file", "number").agg(
        F.array_sort(F.collect_list(F.struct("_split", "_id", "value", "end"))).alias("parts"))
    text = F.concat(
        F.array_join(F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: F.concat(p["value"], p["end"])), ""),
        F.element_at("parts", -1)["value"])
    longer = parts.withColumn("value", text).withColumns({"_split": F.col("parts")[0]["_split"], "_id": F.col("parts")[0]["_id"]}).select(names)
    every = joined.filter("whole").select(names).union(longer).filter(F.length(F.trim("value")) > 0)
    files = starts.groupBy("_file").agg((~F.max_by("left_inside", "_split")).alias("closed"))
    return every, files

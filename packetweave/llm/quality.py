"""Quality rules whose thresholds follow the data, from mergeable quantile sketches per language and source.

A document is measured in whole numbers: word length, symbols and repeated words
per word, repeated lines per line, each in units of 1/4096.  A sketch of a group is
a count per bucket; buckets are exact up to 63 and 1/32 wide above, so a group has
at most a few hundred of them however many documents it holds, and sketches merge by adding
counts (``merged``), over tasks, over sources and over earlier runs alike.

A group's fences lie ``REACH`` spreads outside its quartiles, the spread being at least
a fixed resolution per measure.  A document fails a rule when it lies outside the
fences of its language and source and outside those of its language, so that
neither a small group nor one that differs from the rest of its language loses
ordinary documents.  Few words and much repetition fail by fixed base rules, which
come first; documents that fail them are in no sketch.  DataFrame functions only.

Null and empty texts have no words and fail the base rules.  Null languages and
null sources are groups of their own.  Long texts are measured whole; memory is a
few times that of the text.  Repeated rows count each; values equal to a fence are
inside.  An empty table gives no rows.  Extra columns pass through ``filtered``
untouched, also those named like a measure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetweave.llm.rows import row_key
from packetweave.storage import attach, materialize

# Fixed values of the base rules.
BLANKS = r"[\x20\x09-\x0D]"
BLANK_SIGNS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = (50, 100)

UNIT = 4096
REACH = 6
# Least spread of each measure, in units; ``True`` for those with a lower fence too.
MEASURES = {"word_length": (1024, True), "symbol_share": (64, False), "line_share": (341, False), "repeat_share": (256, False)}
# Values below 2 ** (BITS + 1) have a bucket each; above, each power of two has 2 ** BITS.
BITS = 5
GROUP = ("lang", "source")


def _pairs(items: Column) -> Column:
    """Each item ``x`` with the next one ``y``."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.arrays_zip(F.slice(items, 1, n).alias("x"), F.slice(items, 2, n).alias("y"))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    Each step is a projection of its own, as the next one uses its arrays several times.
    Words repeat when their window of three stands in the text twice: windows are
    sorted with their places, so the work is n log n in the words of a text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(rf"[^{BLANKS[1:]}"))
    first = docs.select(
        *docs.columns, whole.alias("_text"), lines.alias("_lines"), F.array_remove(F.split(whole, BLANKS + "+"), "").alias("_words"))
    k = F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))
    parts = [F.slice("_words", i + 1, k).alias(f"w{i}") for i in range(WINDOW)]
    places = F.slice(F.sequence(F.lit(0), F.size("_words")), 1, k).alias("place")
    second = first.select(
        *docs.columns, F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANK_SIGNS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.arrays_zip(*parts, places)).alias("_windows"))
    same = lambda p: reduce(lambda a, b: a & b, (p["x"][f"w{i}"] == p["y"][f"w{i}"] for i in range(WINDOW)))
    twice = F.transform(F.filter(_pairs(F.col("_windows")), same), lambda p: F.array(p["x"]["place"], p["y"]["place"]))
    third = second.withColumn("_places", F.sort_array(F.array_distinct(F.flatten(twice)))).drop("_windows")
    steps = F.transform(_pairs(F.col("_places")), lambda p: F.least(p["y"] - p["x"], F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda a, x: a + x)
    fourth = third.withColumn("n_repeat_words", F.when(F.size("_places") > 0, covered).otherwise(0).cast("long")).drop("_places")
    repeated = F.col("n_repeat_words") * MOST_REPEATED[1] > F.col("n_words") * MOST_REPEATED[0]
    return fourth.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | repeated)


def share(part: str, whole: str) -> Column:
    """part / whole in units, rounded down; 0 of nothing."""
    return F.expr(f"case when `{whole}` > 0 then (`{part}` * {UNIT}) div `{whole}` else 0 end")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: the key, its group, counts, measures and the group's key."""
    rows = docs.select(F.col(key).alias("doc_id"), *GROUP, F.col(text).alias("text"), row_key(*GROUP).alias("group_key"))
    return with_counts(rows).drop("text").withColumns({
        "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"),
        "line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")})


def bucket(value: Column) -> Column:
    """The bucket of a whole number of 0 or more; buckets ascend with the values."""
    shift = F.greatest(F.length(F.bin(value)) - (BITS + 1), F.lit(0))
    return (shift * (1 << BITS) + F.call_function("shiftright", value, shift)).cast("int")


def ends(number: Column) -> tuple[Column, Column]:
    """Smallest and largest value of a bucket."""
    shift = F.greatest(F.floor(number / (1 << BITS)) - 1, F.lit(0)).cast("int")
    head = number.cast("long") - shift * (1 << BITS)
    left = lambda x: F.call_function("shiftleft", x, shift)
    return left(head), left(head + 1) - 1


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that pass the base rules."""
    listed = F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES))
    return rows.filter(~F.col("base_failed")).select(*GROUP, F.inline(listed)).groupBy(*GROUP, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(*parts: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """One sketch per group out of several, or of finer groups."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """(by, measure, low, high): what lies outside is unusual for its group."""
    group = Window.partitionBy(*by, "measure")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = sketch.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(group))
    quarter = lambda k: F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * k, F.col("bucket")))
    found = placed.groupBy(*by, "measure").agg(quarter(1).alias("_first"), quarter(3).alias("_third"))
    least = F.create_map(*(x for m, (spread, _) in MEASURES.items() for x in (F.lit(m), F.lit(spread))))
    below = F.col("measure").isin(*(m for m, (_, lower) in MEASURES.items() if lower))
    low, high = ends(F.col("_first"))[0], ends(F.col("_third"))[1]
    reach = F.greatest(high - low, F.element_at(least, F.col("measure")).cast("long")) * REACH
    return found.select(*by, "measure", F.when(below, low - reach).alias("low"), (high + reach).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source: low and high of each measure, the wider of its own and its language's."""
    own, language = fences(sketch), fences(merged(sketch, by=("lang",)), ("lang",))
    same = own["lang"].eqNullSafe(language["lang"]) & (own["measure"] == language["measure"])
    both = own.join(language, same).select(
        own["lang"], own["source"], own["measure"], F.least(own["low"], language["low"]).alias("low"), F.greatest(own["high"], language["high"]).alias("high"))
    wide = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")]
    return both.groupBy(*GROUP).agg(*wide).withColumn("group_key", row_key(*GROUP)).drop(*GROUP)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``failed``, the measures outside their fences, and ``kept``."""
    placed = attach(rows, materialize(limits, "quality-limits"), ("group_key",), spread="doc_id")
    outside = [F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in MEASURES]
    failed = F.when(~F.col("base_failed"), F.array_compact(F.array(*outside))).otherwise(F.array().cast("array<string>"))
    return placed.select(*(rows[c] for c in rows.columns), failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality(docs: DataFrame, earlier: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Judged documents, and the sketches to keep; ``earlier`` sketches count as well."""
    rows = materialize(measured(docs, key, text), "quality-measures")
    sketch = sketches(rows) if earlier is None else merged(sketches(rows), earlier)
    sketch = materialize(sketch, "quality-sketches")
    return judged(rows, thresholds(sketch)), sketch


def filtered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, by key and text; all their columns."""
    named = docs.select(row_key(key, text).alias("doc_id"), *GROUP, F.col(text).alias("text"))
    good = quality(named)[0].filter("kept").select(F.col("doc_id").alias("_kept_key")).distinct()
    return docs.select(F.struct("*").alias("_row"), row_key(key, text).alias("_kept_key")).join(good, "_kept_key", "left_semi").select("_row.*")

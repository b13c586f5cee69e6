"""Positions of regular-expression matches, with DataFrame functions only.

``regexp_extract_all`` returns texts, not positions.  A second pass with the
same pattern, anchored by ``\\G`` to the end of the match before, returns the gap
in front of every match, so positions are running sums of lengths.  The second
pass runs only for texts with a match.  Positions are code points, end exclusive.

Work is in proportion to the text and its matches: running totals go over blocks of
``BLOCK`` values and then over the blocks, and parts of a text are cut from
chunks of ``CHUNK`` code points, not from the start of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"


BLOCK, CHUNK = 256, 4096


def held(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value computed once however often it is used, also inside lambdas."""
    return F.transform(F.array(value), of)[0]


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Totals up to each of the bigint values, by an associative step."""

    def over(block: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        return F.aggregate(block, empty, lambda done, v: F.concat(done, F.array(F.coalesce(step(F.try_element_at(done, F.lit(-1)), v), v))))

    def blocks(vs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda b: over(F.slice(vs, b * BLOCK + 1, F.lit(BLOCK))))

    def carried(bs: Column) -> Column:
        ends = over(F.transform(bs, lambda block: F.element_at(block, -1)))
        return held(ends, lambda es: F.flatten(F.transform(bs, lambda block, i: F.when(i == 0, block).otherwise(
            F.transform(block, lambda v: step(F.get(es, i - 1), v))))))

    return held(values, lambda vs: F.when(F.size(vs) > 0, held(blocks(vs), carried)).otherwise(vs))


def chunked(text: Column) -> Column:
    """The text in chunks, for ``part``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(chunks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a chunked text, at most up to its end; empty for none."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    cut = F.substring(near, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))
    return F.when(end > start, cut).otherwise("")


def located(text: Column, found: Column, pattern: str) -> Column:
    """Spans of ``found``, which is ``regexp_extract_all(text, pattern, 0)``.

    Keep ``found`` a column of an earlier select, so that it is computed once.
    """
    gaps = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)(?:{pattern})"), 1)
    sizes = F.zip_with(gaps, found, lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))
    spans = F.zip_with(running(sizes, lambda a, b: a + b), found, lambda end, hit: F.struct(
        (end - F.length(hit)).cast("int").alias("start"), end.cast("int").alias("end"), hit.alias("text")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN))


def all_matches(text: Column, pattern: str) -> Column:
    """Whole texts of the leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def labels(spans: Column) -> Column:
    """``kind:start:end`` of spans that hold these fields, comma-joined in their order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every normalised item.  Tasks stream
the words of their documents through it and track the longest matching length;
where it reaches the window, or a whole shorter item ends, those words are hit.
Per-document work needs no shuffle.  The item side is bounded: an automaton
holds at most ``AUTOMATON_WORDS`` words besides its last item; more items give
more automata, which documents pass one after the other.

Null texts have no words and are never contaminated; items without words match
nothing; items with equal ids count once; a null id reads as ``null``.  Repeated
documents are judged alike.  An empty table on either side gives no hits.
Other columns are kept; columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words are runs of digits, letters and anything beyond ASCII, A-Z in lower case.
WINDOW = 13
ONE_WORD_IN = 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

AUTOMATON_WORDS = 100_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("longest", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_spans", SPANS)])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


class SuffixAutomaton:
    """Suffix automaton over several word sequences, with the items behind each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.steps: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = list(items)
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items_at: dict[int, set[str]] = {}
        ends: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            self._place(item, words, ends)
        self.shortest = min([window, *(n for at in ends.values() for n, _ in at)])
        self._inherit(ends)

    def _new(self, steps: dict[bytes, int], link: int, length: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """The state of exactly one word more than ``state``; a longer target is cloned."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(dict(self.steps[target]), self.link[target], self.length[state] + 1)
        self.link[target] = clone
        while state >= 0 and self.steps[state].get(word) == target:
            self.steps[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        known = self.steps[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._new({}, 0, self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.steps[state]:
            self.steps[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.steps[state][word])
        return new

    def _place(self, item: str, words: list[bytes], ends: dict[int, list[tuple[int, str]]]) -> None:
        """Notes the item at the state of each of its windows, or of the whole item if shorter."""
        state = 0
        for n, word in enumerate(words, 1):
            state = self.steps[state][word]
            if n >= self.window:
                while self.length[self.link[state]] >= self.window:
                    state = self.link[state]
                self.items_at.setdefault(state, set()).add(item)
        if 0 < len(words) < self.window:
            ends.setdefault(state, []).append((len(words), item))

    def _inherit(self, ends: dict[int, list[tuple[int, str]]]) -> None:
        """Per state: where its window's state is, and which short items end with it."""
        count = len(self.link)
        self.at_window = list(range(count))
        self.short: list[tuple] = [()] * count
        for state in sorted(range(1, count), key=self.length.__getitem__):
            link = self.link[state]
            if self.length[link] >= self.window:
                self.at_window[state] = self.at_window[link]
            own = tuple(ends.get(state, ()))
            self.short[state] = own + self.short[link] if own else self.short[link]

    def scan(self, words: list[bytes]) -> tuple[int, bytearray, set[str]]:
        """Longest match, a mark per word that is hit, and the items behind the hits."""
        steps, link, length, short, window, least = self.steps, self.link, self.length, self.short, self.window, self.shortest
        root, marks, items, longest, state, run = steps[0], bytearray(len(words)), set(), 0, 0, 0
        for at, word in enumerate(words):
            further = steps[state].get(word)
            if further is not None:
                run += 1
            else:
                while state and further is None:
                    state = link[state]
                    further = steps[state].get(word)
                if further is None:
                    run = 0
                    continue
                run = length[state] + 1
            state = further
            if run < least:
                continue
            if run > longest:
                longest = run
            if run >= window:
                marks[at + 1 - window : at + 1] = b"\x01" * window
                items |= self.items_at[self.at_window[state]]
            for n, item in short[state]:
                if n <= run:
                    marks[at + 1 - n : at + 1] = b"\x01" * n
                    items.add(item)
        return longest, marks, items


def _runs(marks: bytearray) -> list[tuple[int, int]]:
    found, at = [], marks.find(1)
    while at >= 0:
        end = marks.find(0, at)
        end = len(marks) if end < 0 else end
        found.append((at, end))
        at = marks.find(1, end)
    return found


def _pass(docs: DataFrame, automaton, text: str, first: bool) -> DataFrame:
    """Judges documents with one automaton, and adds to what earlier ones found."""
    kept = [f for f in docs.schema.fields if f.name not in RESULT.names]
    out = T.StructType(kept + RESULT.fields)
    source = docs.select(*[f.name for f in kept], *([] if first else RESULT.names))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            columns: list[list] = [[], [], [], [], []]
            old = None if first else [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("longest", "item_ids", "hit_spans")]
            for i, value in enumerate(texts):
                words = words_of(value.as_py() or b"")
                longest, marks, items = machine.scan(words)
                if old:
                    longest = max(longest, old[0][i])
                    items |= set(old[1][i])
                    for span in old[2][i]:
                        marks[span["start"] : span["end"]] = b"\x01" * (span["end"] - span["start"])
                spans = [{"start": a, "end": b} for a, b in _runs(marks)]
                for column, x in zip(columns, (len(words), marks.count(1), longest, sorted(items), spans), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(own + made, names=out.names)

    return source.mapInArrow(judge, out)


def item_automata(items: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> Iterator[SuffixAutomaton]:
    """Builds automata from the items; the driver holds the items of one at a time."""
    rows, size = [], 0
    chosen = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").filter("text is not null")
    for item, text in chosen.toLocalIterator():
        words = words_of(text.encode())
        rows.append((item, words))
        size += len(words)
        if size >= most_words:
            yield SuffixAutomaton(rows, window)
            rows, size = [], 0
    if rows:
        yield SuffixAutomaton(rows, window)


def find_contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW,
    one_word_in: int = ONE_WORD_IN, most_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """Adds n_words, n_hit, longest, item_ids, hit_spans (word positions) and contaminated."""
    context = docs.sparkSession.sparkContext
    found, first = docs, True
    for automaton in item_automata(items, window, most_words):
        found, first = _pass(found, context.broadcast(automaton), text, first), False
    if first:
        found = _pass(found, context.broadcast(SuffixAutomaton([], window)), text, True)
    judged = (F.col("n_hit") > 0) & (F.col("n_hit") * one_word_in >= F.col("n_words"))
    return found.withColumn("contaminated", judged)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less the words of the spans, and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def _numbered(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """Columns by number, so that none is called like a result; and the name of the text."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), f"c{docs.columns.index(text)}"


def uncontaminated(docs: DataFrame, items: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents below the coverage limit, as they are."""
    plain, own = _numbered(docs, text)
    return find_contamination(plain, items, own, **limits).filter("not contaminated").select(*plain.columns).toDF(*docs.columns)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **limits) -> DataFrame:
    """Drops documents over the coverage limit and cuts hit spans from the others."""
    plain, own = _numbered(docs, text)
    columns = plain.columns
    judged = find_contamination(plain, items, own, **limits).filter("not contaminated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(own)
            spans = batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
            texts = [
                without_spans(t.as_py(), [(s["start"], s["end"]) for s in found]) if found else t.as_py()
                for t, found in zip(batch.column(place).cast(pa.binary()), spans, strict=True)]
            arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if n == own else batch.column(batch.schema.get_field_index(n)) for n in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return judged.select(*columns, "hit_spans").mapInArrow(cut, plain.schema).toDF(*docs.columns)

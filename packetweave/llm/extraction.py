"""Main text of pages, with site templates found by counting element subtrees.

Each task parses its pages once and emits a hash per container subtree.  Spark
counts, per host and per section of it (the first directory of the path), the different page bodies
that hold each hash; subtrees on many of either are the site's template.  A second parse deletes those, together with elements
that the markup itself names as menu, footer, advert and the like, and joins the blocks of
the article that remain.

Copies of a body count once, and paragraphs, headings and list items are never
deleted for recurring, so that an article which many pages of a host carry stays.

Null or empty pages give empty text.  Pages without a host have no template.
Repeated rows are treated alike; very long pages are parsed whole, without
recursion.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave.storage import materialize

# Fixed values of the markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr audio button canvas iframe input noscript object script select style svg template textarea video".split())
CONTAINERS = frozenset("aside details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
DROPPED = frozenset(
    "aside audio button canvas dialog embed footer form frame frameset head header iframe input menu nav noframes noscript object script "
    "select style svg template textarea title video xmp".split())
NEVER = frozenset("html body main article".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie "
    "cookies dialog disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup promo promoted promotion recommended related reply respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toolbar widget widgets".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
}
PARAGRAPH = frozenset({"p"})
IMPLIED = {tag: PARAGRAPH | ends for tag, ends in CLOSES.items()}
SCOPES = frozenset("html body article main section div aside nav ul ol dl table blockquote form footer header td th li fieldset figure".split())
# Comments, declarations, tags without "<" inside, text, or a "<" of its own; never back over what was read.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>"'<]*+)(?=[\s/>])((?:[^>"'<]*+(?:"[^"<]*+"|'[^'<]*+'))*+[^>"'<]*+)>|[^<]+|<""", re.DOTALL)
OPENING = re.compile(r"</?[a-zA-Z]")
NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s/]|$)|hidden\s*=|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)
PART = re.compile(r"[-_]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements about the article, which may hold articles of their own; the only ids that count within main.
ABOUT = frozenset("comment comments disqus recommended related reply respond".split())
# A subtree is template on at least so many bodies, and at least this share of the bodies of the host or of a section of it.
LEAST_BODIES, LEAST_SHARE = 5, 0.1


@dataclass
class Element:
    tag: str
    dropped: bool
    first: int
    parts: list[bytes] = field(default_factory=list)
    last: int = 0
    digest: int = 0
    named: frozenset[str] = frozenset()
    holds: bool = False


@dataclass
class Page:
    """Text blocks in page order, and elements with the range of blocks each holds."""

    blocks: list[str] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def boilerplate(tag: str, names: list[tuple[str, str]], within: frozenset[str]) -> frozenset[str]:
    """Names that mark an element: whole class names, ids and roles of which every part is in ``NAMED``.

    Headings and inline elements have none, and an id in an article is an anchor of its text.
    """
    if tag in INLINE or tag in HEADINGS:
        return frozenset()
    found = set()
    for kind, value in names:
        parts = [set(filter(None, PART.split(name))) for name in value.split()]
        own = {p for some in parts if some and some <= NAMED for p in some}
        if kind == "id" and "article" in within:
            own = set()
        elif kind == "id" and "main" in within:
            own &= ABOUT
        found |= own
    return frozenset(found)


class _Next:
    """Where a pattern is found next; places asked for ascend, so a text is searched once."""

    def __init__(self, pattern: str, text: str) -> None:
        self.search, self.text, self.start, self.at = re.compile(pattern).search, text, 0, -1

    def __call__(self, place: int) -> int:
        """The place of the next match from ``place`` on, or the end of the text."""
        if not self.start <= place <= self.at:
            found = self.search(self.text, place)
            self.start, self.at = place, found.start() if found else len(self.text)
        return self.at


class _Tags:
    """Ends of tags, with quoted values skipped.

    Where a tag ends follows from any place outside quotes inside it, so that is
    kept for each such place: tags that never end are not searched again and again.
    """

    def __init__(self, html: str) -> None:
        self.html, self.known = html, {}
        self.name, self.special = _Next(r"[\s/>]", html), _Next("[>\"']", html)
        self.closing = {quote: _Next(quote, html) for quote in "\"'"}

    def end(self, place: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``place``, or -1."""
        passed, found = [], -1
        while place not in self.known:
            passed.append(place)
            at = self.special(place)
            if at == len(self.html):
                break
            if self.html[at] == ">":
                found = at
                break
            close = self.closing[self.html[at]](at + 1)
            if close == len(self.html):
                break
            place = close + 1
        else:
            found = self.known[place]
        self.known.update(dict.fromkeys(passed, found))
        return found


class _Builder:
    def __init__(self) -> None:
        self.page, self.open, self.run, self.skip = Page(), [Element("", False, 0)], [], 0
        self.within = {"article": 0, "main": 0}
        # Depths of the open elements by tag, of the blocks and of the scopes among them.
        self.depths: dict[str, list[int]] = {}
        self.blocks, self.scopes = [0], [0]

    def flush(self) -> None:
        if self.run:
            text = " ".join(references.unescape("".join(self.run)).split())
            self.run = []
            if text:
                self.page.blocks.append(text)

    def text(self, text: str) -> None:
        self.open[-1].parts.append(text.strip().encode("utf-8", "surrogatepass"))
        if not self.skip:
            self.run.append(text)

    def start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            self._imply(tag)
        elif tag == "br":
            self.run.append(" ")
        if tag in VOID:
            self.open[-1].parts.append(tag.encode())
            return
        given = [(kind.lower(), f"{a}{b}{c}".lower()) for kind, a, b, c in NAMES.findall(attributes)] if attributes else []
        names = "".join(f"{value} " for _, value in given)
        named = boilerplate(tag, given, frozenset(t for t, n in self.within.items() if n)) if given else frozenset()
        dropped = tag in DROPPED or (tag == "article" and bool(named & {"comment", "comments", "reply"}))
        dropped = dropped or (tag not in NEVER and bool(attributes) and HIDDEN.search(attributes) is not None)
        element = Element(tag, dropped, len(self.page.blocks))
        element.named = named if tag not in NEVER else frozenset()
        if tag in self.within:
            self.within[tag] += 1
        element.parts.append(f"{tag} {names}".encode("utf-8", "surrogatepass"))
        depth = len(self.open)
        self.open.append(element)
        self.depths.setdefault(tag, []).append(depth)
        if tag not in INLINE:
            self.blocks.append(depth)
        if tag in SCOPES:
            self.scopes.append(depth)
        self.skip += dropped

    def _imply(self, tag: str) -> None:
        """Closes what a block start closes: a paragraph, and items of the same list."""
        ends = IMPLIED.get(tag, PARAGRAPH)
        at = len(self.scopes) - 1
        while at and self.open[self.scopes[at]].tag in ends:
            at -= 1
        scope = self.scopes[at]
        least = 0
        for end in ends:
            held = self.depths.get(end)
            if held and held[-1] > scope:
                depth = held[bisect_right(held, scope)]
                least = min(least, depth) if least else depth
        if least:
            self.close_to(least)

    def end(self, tag: str) -> None:
        held = self.depths.get(tag)
        if held and (tag not in INLINE or held[-1] > self.blocks[-1]):
            self.close_to(held[-1])

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            if self.open[-1].tag not in INLINE:
                self.flush()
            element = self.open.pop()
            place = len(self.open)
            self.depths[element.tag].pop()
            if self.blocks[-1] == place:
                self.blocks.pop()
            if self.scopes[-1] == place:
                self.scopes.pop()
            element.last = len(self.page.blocks)
            element.digest = xxhash.xxh3_64_intdigest(b"\0".join(element.parts)) - (1 << 63)
            element.parts = []
            self.skip -= element.dropped
            if element.tag in self.within:
                self.within[element.tag] -= 1
            self.open[-1].holds |= element.holds or (element.tag in self.within and not element.dropped and element.last > element.first)
            self.open[-1].parts.append(element.digest.to_bytes(8, "big", signed=True))
            if element.tag not in INLINE:
                self.page.elements.append(element)


def parse(html: str) -> Page:
    """Elements and text blocks; text within dropped elements is left out."""
    builder, tags, at, size = _Builder(), _Tags(html), 0, len(html)
    while at < size:
        token = TOKEN.match(html, at)
        closing, tag, attributes = token.groups()
        if tag is not None:
            at = token.end()
        elif token[0] != "<":
            at = token.end()
            if token[0][0] != "<":
                builder.text(token[0])
            continue
        else:
            named = OPENING.match(html, at)
            place = tags.name(named.end()) if named else -1
            end = tags.end(place) if named else -1
            if end < 0:
                builder.text("<")
                at += 1
                continue
            closing, tag, attributes, at = named[0][1] == "/", html[named.end() - 1 : place], html[place:end], end + 1
        tag = tag.lower()
        if closing:
            builder.end(tag)
            continue
        builder.start(tag, attributes)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
            end = stop.start() if stop else size
            builder.text(html[at:end])
            at = end
    builder.close_to(1)
    builder.flush()
    return builder.page


def kept_blocks(page: Page) -> bytearray:
    """1 for each block outside the elements that their names mark as boilerplate.

    What holds an article or main is kept, unless it is about the article and another stands outside.  On a page
    without either, an element with at least half of the text is kept.
    """
    keep = bytearray(b"\1" * len(page.blocks))
    held = [e for e in page.elements if e.tag in ("article", "main") and not e.dropped and e.last > e.first]
    first, last = min((e.first for e in held), default=0), max((e.last for e in held), default=0)
    chars = [0, *accumulate(map(len, page.blocks))]
    for e in page.elements:
        if not e.named or e.last == e.first:
            continue
        if e.holds:
            gone = e.named <= ABOUT and (first < e.first or last > e.last)
        else:
            gone = bool(held) or 2 * (chars[e.last] - chars[e.first]) < chars[-1]
        if gone:
            keep[e.first : e.last] = bytes(e.last - e.first)
    return keep


def main_ranges(page: Page, kept: bytearray) -> list[tuple[int, int]]:
    """Block ranges of the outermost articles with text, else of main, else everything."""
    before = [0, *accumulate(kept)]
    for tag in ("article", "main"):
        found = sorted((e.first, e.last) for e in page.elements if e.tag == tag and not e.dropped and before[e.last] > before[e.first])
        outer = []
        for first, last in found:
            if outer and first < outer[-1][1]:
                outer[-1] = (outer[-1][0], max(last, outer[-1][1]))
            else:
                outer.append((first, last))
        if outer:
            return outer
    return [(0, len(page.blocks))]


def main_text(page: Page, templates: frozenset[int] = frozenset()) -> str:
    named = kept_blocks(page)
    keep = bytearray(len(page.blocks))
    for first, last in main_ranges(page, named):
        keep[first:last] = named[first:last]
    for e in page.elements:
        if e.digest in templates and e.tag in CONTAINERS:
            keep[e.first : e.last] = bytes(e.last - e.first)
    return "\n\n".join(b for b, kept in zip(page.blocks, keep, strict=True) if kept)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def section_of(url):
    """The first directory of the path, empty for pages in the root."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)/", 1)


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """(host, section, body, subtree) per container subtree; body is a hash of the main text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, sections, bodies, subtrees = [], [], [], []
            for host, section, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                page = parse(html.as_py() or "")
                body = xxhash.xxh3_64_intdigest(main_text(page).encode("utf-8", "surrogatepass")) - (1 << 63)
                # Zero stands for the page itself, so that bodies are counted the same way.
                own = {e.digest for e in page.elements if e.tag in CONTAINERS} | {0}
                hosts += [host] * len(own)
                sections += [section] * len(own)
                bodies += [body] * len(own)
                subtrees += own
            columns = [pa.array(hosts, pa.string()), pa.array(sections, pa.string()), pa.array(bodies, pa.int64()), pa.array(subtrees, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "section", "body", "subtree"])

    rows = pages.select(host_of(F.col("url")).alias("host"), section_of(F.col("url")).alias("section"), "html").filter("host <> ''")
    return rows.mapInArrow(emit, "host string, section string, body long, subtree long")


def site_templates(pages: DataFrame, least_bodies: int = LEAST_BODIES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, section, templates): hashes that recur on the section, or with a null section on the whole host.

    At most 1 / share times the containers of a page on average.
    """
    # A null section stands for the whole host, where copies of a body in several sections count once.
    scopes = F.explode(F.array(F.col("section"), F.lit(None).cast("string")))
    rows = subtree_hashes(pages).select("host", scopes.alias("section"), "body", "subtree").distinct()
    counts = materialize(rows.groupBy("host", "section", "subtree").count(), "subtree-counts")
    bodies = counts.filter("subtree = 0").select("host", F.col("section").alias("of"), F.col("count").alias("bodies"))
    many = (F.col("count") >= least_bodies) & (F.col("count") >= F.col("bodies") * least_share)
    bodies = bodies.withColumnRenamed("host", "on")
    same = (F.col("host") == F.col("on")) & F.col("section").eqNullSafe(F.col("of"))
    recurring = counts.filter(f"subtree <> 0 and count >= {least_bodies}").join(bodies, same).filter(many)
    return recurring.groupBy("host", "section").agg(F.collect_list("subtree").alias("templates"))


def extract(pages: DataFrame, **limits) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    templates = materialize(site_templates(pages, **limits), "site-templates")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for html, own in zip(batch.column(2), batch.column(3), strict=True):
                made.append(main_text(parse(html.as_py() or ""), frozenset(own.as_py() or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    whole = templates.filter("section is null").select("host", F.col("templates").alias("whole"))
    parts = templates.filter("section is not null").select("host", "section", F.col("templates").alias("part"))
    none = F.array().cast("array<bigint>")
    rows = (
        pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), section_of(F.col("url")).alias("section"))
        .join(whole, "host", "left").join(parts, ["host", "section"], "left")
        .withColumn("templates", F.concat(F.coalesce("whole", none), F.coalesce("part", none))))
    kinds = dict(rows.dtypes)
    return rows.select("page_id", "url", "html", "templates").mapInArrow(
        texts, f"page_id {kinds['page_id']}, url string, text string, n_chars long")

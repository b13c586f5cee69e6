"""Personal data: patterns propose spans, checksums confirm, context adjusts the score.

DataFrame functions only, in one scan without a shuffle.  Card numbers must
pass Luhn, bank account numbers mod-97, addresses their value range.  Each span
carries a score: a prior per kind, more with a checksum, more again when a word
that goes with the kind stands nearby.

Null and empty texts have no spans; a very long text is searched whole; repeated
rows and ties are treated alike; an empty table gives an empty result.  Extra
columns are passed through; a clashing ``pii`` column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave.llm.rows import unused
from packetweave.llm.spans import all_matches, chunked, located, part, running
from packetweave.llm.spans import held as held_once

# The base kinds in their order, then the added kind.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
CONTEXT = {
    "email": "(?i)e-?mail|contact|write to|reach|correo|courriel|kontakt",
    "ip": r"(?i)\bip\b|address|server|host|login|adresse|direcci",
    "card": "(?i)card|credit|visa|master|payment|carte|karte|tarjeta",
    "phone": r"(?i)phone|\btel|call|mobile|fax|handy|llam",
    "iban": "(?i)iban|account|bank|konto|compte|cuenta",
}
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4}
CHECKSUM, NEARBY, WINDOW = 0.4, 0.2, 40
# A validated base span scores at least 0.5, so this keeps every one of them.
THRESHOLD = 0.5
PII = "array<struct<rank:int,start:int,end:int,kind:string,text:string,score:double>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True when the digits pass the Luhn check."""
    places = F.split(F.reverse(number), "")

    def value(digit: Column, place: Column) -> Column:
        d = digit.cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(place % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True when country and check digits, moved to the end, leave remainder 1."""
    packed = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(packed, 5, 64), F.substring(packed, 1, 4)), "")

    def step(rest: Column, sign: Column) -> Column:
        n = F.when(sign.between("0", "9"), F.ascii(sign) - 48).otherwise(F.ascii(sign) - 55)
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.length(packed).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)


def small_parts(address: Column) -> Column:
    """True when all parts of a dotted address are at most 255."""
    parts = F.transform(F.split(address, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


VALID = {
    "email": lambda t: F.lit(True),
    "ip": small_parts,
    "card": lambda t: F.when(F.length(digits(t)).between(16, 19), luhn(digits(t))).otherwise(False),
    "phone": lambda t: F.length(digits(t)).between(8, 15),
    "iban": mod97,
}


def _score(chunks: Column, size: Column, span: Column, kind: str) -> Column:
    before = part(chunks, F.greatest(span["start"] - WINDOW, F.lit(0)), span["start"])
    around = F.concat(before, F.lit(" "), part(chunks, span["end"], F.least(span["end"] + WINDOW, size)))
    fixed = PRIOR[kind] + (CHECKSUM if kind in ("card", "iban") else 0.0)
    return F.least(F.lit(1.0), F.lit(fixed) + F.when(around.rlike(CONTEXT[kind]), NEARBY).otherwise(0.0))


def find_pii(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``pii``: confirmed spans by kind and start, with text and score."""
    whole = F.coalesce(F.col(text), F.lit(""))
    held = {k: unused(docs.columns, f"found_{k}") for k in PATTERNS}
    found = docs.withColumns({held[k]: all_matches(whole, p) for k, p in PATTERNS.items()})
    chunks, length = unused(docs.columns, "text_chunks"), unused(docs.columns, "text_length")
    matched = F.greatest(*(F.size(held[k]) for k in PATTERNS)) > 0
    # Columns of their own: inside a lambda each would be computed once per span.
    found = found.withColumns({chunks: F.when(matched, chunked(whole)).otherwise(F.array().cast("array<string>")), length: F.length(whole)})
    kinds = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = F.filter(located(whole, F.col(held[kind]), pattern), lambda s: VALID[kind](s["text"]))
        kinds.append(F.transform(spans, lambda s: F.struct(
            F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            s["text"].alias("text"), _score(F.col(chunks), F.col(length), s, kind).alias("score"))))
    spans = F.filter(F.array_sort(F.concat(*kinds).cast(PII)), lambda s: s["score"] >= threshold)
    return found.withColumn("pii", spans).drop(*held.values(), chunks, length)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def told(chunks: Column, items: Column, ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, 1, F.size(ends) - 1))
        marks = F.zip_with(before, items, lambda at, s: F.when(s["start"] >= at, F.concat(
            part(chunks, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
        return F.concat(F.array_join(marks, ""), part(chunks, F.element_at(ends, -1), F.length(text)))

    reach = lambda items: running(F.transform(items, lambda s: s["end"].cast("long")), F.greatest)
    cut = held_once(chunked(text), lambda chunks: held_once(ordered, lambda items: held_once(reach(items), lambda ends: told(chunks, items, ends))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same columns, with confirmed personal data masked in the text."""
    found = find_pii(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")))
    mended = found.withColumn("row", F.col("row").withField(text, masked(F.col("text"), F.col("pii"))))
    return mended.select("row.*")

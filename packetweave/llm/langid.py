"""Language identification by Bayesian fusion of text and context evidence.

Four kinds of evidence add up as log probabilities: the text (byte trigrams of
letters, multinomial per language), the language that the markup declares, the
suffix of the address, and a prior of the host, smoothed towards its domain and
that towards the whole corpus.  All of it is estimated from all documents by grouped
aggregation: trigram counts under the declared language, then declared, suffix, domain and
host counts under what the text says.  ``und`` (undetermined) is one of the
languages; its trigrams are uniform, so unknown scripts and noise fall to it.

Tables held by tasks are bounded: ``BUCKETS`` times the number of languages.  Hosts
and suffixes are joined.

Null or empty texts and texts without letters are ``und`` and rejected, whatever
their context says.  Null hosts share the corpus prior; null or unknown
declarations and null suffixes are kinds of their own.  Ties go to the earlier language.
Repeated rows are judged alike.  An empty table gives no rows.  Other columns are kept by ``identify``;
those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave.llm.rows import row_key, unused
from packetweave.storage import materialize

LANGUAGES = ("de", "en", "es", "fr")
CLASSES = (*LANGUAGES, "und")
BUCKETS = 1 << 14
SLICE = 1 << 20
# Counts added to trigrams, to declared languages and suffixes, and the weight of the level above a host or domain.
TRIGRAM_PRIOR, CONTEXT_PRIOR, LEVEL_WEIGHT = 0.5, 1.0, 20.0
# Trigrams of a text are not independent: each counts for a fraction, and a long text for no more than so many.
TEMPER, MOST_TRIGRAMS = 0.3, 1000
UNDETERMINED = 1e-3
LEAST_POSTERIOR = 0.5
UNIT = 1_000_000
RESULT = ("language", "posterior", "n_trigrams", "accepted")
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the trigrams of letters and blanks, a slice of the text at a time."""
    if not text:
        return
    raw = np.frombuffer(b" " + text.lower().encode().translate(_KEEP) + b" ", np.uint8)
    for at in range(0, len(raw) - 2, SLICE):
        part = raw[at : at + SLICE + 2].astype(np.uint32)
        code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        code = code[code != 0x202020]
        yield (code * np.uint32(2654435761)) >> np.uint32(32 - 14)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Trigrams by language and bucket, over all documents with a known declaration."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
        for batch in batches:
            for text, declared in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if declared in LANGUAGES:
                    for codes in trigrams(text.as_py()):
                        sums[LANGUAGES.index(declared)] += np.bincount(codes, minlength=BUCKETS)
        language, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(language, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[language, bucket])], names=["language", "bucket", "n"])

    rows = docs.select("text", "declared").mapInArrow(count, "language int, bucket int, n long")
    # At most len(LANGUAGES) * BUCKETS rows, however many documents.
    sums = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
    for part in rows.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        language, bucket, n = (c.to_numpy() for c in part.columns)
        sums[language, bucket] = n
    return sums


def text_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities by bucket and class; a language without counts never wins on text."""
    smooth = counts + TRIGRAM_PRIOR
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    logs[counts.sum(axis=1) == 0] = np.log(1e-3 / BUCKETS)
    return np.vstack([logs, np.full(BUCKETS, -np.log(BUCKETS))]).T.copy()


def text_scores(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """Replaces text by n_trigrams and scores: tempered log likelihoods by class."""
    kept = [f for f in docs.columns if f != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            counts, scores = [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                total, n = np.zeros(len(CLASSES)), 0
                for codes in trigrams(text.as_py()):
                    total += logs[codes].sum(axis=0)
                    n += len(codes)
                counts.append(n)
                scores.append((total * (TEMPER * min(n, MOST_TRIGRAMS) / n if n else 0.0)).round(6).tolist())
            own = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(counts, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=[*kept, "n_trigrams", "scores"])

    return docs.mapInArrow(score, f"{kinds}, n_trigrams long, scores array<double>")


def softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """Expected documents by class, in whole millionths, so that the order of addition doesn't matter."""
    sums = [F.sum(F.floor(F.element_at("belief", i + 1) * UNIT)).alias(f"_{i}") for i in range(len(CLASSES))]
    counts = F.array(*(F.col(f"_{i}") / UNIT for i in range(len(CLASSES))))
    return rows.groupBy(*by).agg(*sums).select(*by, counts.alias("counts"))


def _smoothed(counts: Column, above: Column) -> Column:
    """Shares by class, with ``LEVEL_WEIGHT`` documents of the level above."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, above, lambda n, p: (n + p * LEVEL_WEIGHT) / (total + LEVEL_WEIGHT))


def _floats(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _context(rows: DataFrame, column: str, totals: list[float]) -> DataFrame:
    """log P(value | class) of each value of a context column, null one of them."""
    sums = _sums(rows, column)
    logs = F.zip_with("counts", _floats(totals), lambda n, t: F.log((n + CONTEXT_PRIOR) / (t + 100 * CONTEXT_PRIOR)))
    return materialize(sums.select(F.coalesce(column, F.lit("")).alias(column), logs.alias(f"{column}_logs")), f"langid-{column}")


def fused(scored: DataFrame) -> DataFrame:
    """Adds language, posterior and accepted to rows with declared, suffix, domain, host, n_trigrams and scores."""
    rows = scored.withColumns({c: F.coalesce(c, F.lit("")) for c in ("suffix", "domain", "host")}).withColumn(
        "declared", F.when(F.col("declared").isin(*LANGUAGES), F.col("declared")).otherwise(""))
    start = _floats(np.log([(1 - UNDETERMINED) / len(LANGUAGES)] * len(LANGUAGES) + [UNDETERMINED]))
    rows = rows.withColumn("belief", softmax(F.zip_with("scores", start, lambda s, p: s + p)))
    told = rows.filter("n_trigrams > 0")
    everything = _sums(told.withColumn("_all", F.lit(0)), "_all").first()
    totals = list(everything["counts"]) if everything else [0.0] * len(CLASSES)
    whole = sum(totals)
    shares = _floats([(t + p) / (whole + 1) for t, p in zip(totals, [(1 - UNDETERMINED) / len(LANGUAGES)] * len(LANGUAGES) + [UNDETERMINED], strict=True)])
    domains = materialize(_sums(told, "domain").select("domain", _smoothed(F.col("counts"), shares).alias("above")), "langid-domain")
    hosts = _sums(told, "domain", "host").join(domains, "domain")
    prior = F.transform(_smoothed(F.col("counts"), F.col("above")), lambda p: F.log(p))
    hosts = materialize(hosts.select("domain", "host", prior.alias("host_logs")), "langid-host")
    zero, general = _floats([0.0] * len(CLASSES)), F.transform(shares, lambda p: F.log(p))
    joined = (
        rows.join(_context(told, "declared", totals), "declared", "left").join(_context(told, "suffix", totals), "suffix", "left")
        .join(hosts, ["domain", "host"], "left")
        .withColumn("context", F.zip_with(F.coalesce("declared_logs", zero), F.coalesce("suffix_logs", zero), lambda a, b: a + b))
        .withColumn("context", F.zip_with("context", F.when(F.col("host") == "", general).otherwise(F.coalesce("host_logs", general)), lambda a, b: a + b))
        .withColumn("belief", softmax(F.zip_with("scores", "context", lambda s, c: s + c)))
    )
    best = F.element_at(F.array(*(F.lit(c) for c in CLASSES)), F.array_position("belief", F.array_max("belief")).cast("int"))
    language = F.when(F.col("n_trigrams") > 0, best).otherwise("und")
    posterior = F.when(F.col("n_trigrams") > 0, F.round(F.array_max("belief"), 6)).otherwise(0.0)
    named = joined.withColumn("language", language).withColumn("posterior", posterior)
    accepted = (F.col("language") != "und") & (F.col("posterior") >= LEAST_POSTERIOR)
    return named.withColumn("accepted", accepted).drop("declared_logs", "suffix_logs", "host_logs", "context", "belief", "scores")


def identify(
    docs: DataFrame, key: str, text: Column, declared: Column, suffix: Column | None = None,
    domain: Column | None = None, host: Column | None = None,
) -> DataFrame:
    """(key, language, posterior, n_trigrams, accepted) of every row.

    declared: language of the markup; suffix, domain, host: parts of the address.
    """
    absent = F.lit(None).cast("string")
    given = {"declared": F.lower(F.substring(declared, 1, 2)), "suffix": suffix, "domain": domain, "host": host}
    rows = docs.select(F.col(key), text.alias("text"), *((absent if c is None else c).alias(n) for n, c in given.items()))
    model = text_model(trigram_counts(rows))
    scored = materialize(text_scores(rows, model), "langid-scores")
    return fused(scored).select(key, *RESULT)


def document_languages(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """For ``documents``: lang is what is declared, the source stands for the host."""
    return identify(docs, key, F.col("text"), F.col("lang"), host=F.col("source"))


def page_languages(pages: DataFrame) -> DataFrame:
    """For ``pages``: declared by the html element, suffix and host from the address."""
    declared = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2})""", 1)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>|&[a-zA-Z0-9#]{1,10};", " ")
    return identify(pages, "page_id", visible, declared, F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), host)


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are accepted; rows equal in text, lang and source are judged alike."""
    key = unused(docs.columns, "row_key")
    marked = docs.withColumn(key, row_key("text", "lang", "source"))
    # Rejected rows are usually few, so that texts need not be shuffled; Spark checks their size.
    rejected = materialize(document_languages(marked, key).filter("not accepted").select(key).distinct(), "langid-rejected")
    return marked.join(rejected, key, "left_anti").select(*docs.columns)

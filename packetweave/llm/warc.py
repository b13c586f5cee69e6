"""WARC archives: writing with revisits, reading back by boundary-chain verification.

A record is found by its magic line, but payloads may hold that line too.  Tasks
split archives at every magic line and emit, for each candidate, its offset and
that of its successor by the declared length.  Only candidates on the chain
from the start of the file are records.  Chains of neighbours are first joined
to runs, then pointer jumping over the runs finds what is reachable in a
logarithmic number of rounds.

Null payloads are empty; null ids are written as ``null``, never count as
smallest and read back as null; null addresses have no header line.  Equal rows
with the smallest id are all responses.  A candidate whose length runs past the
file is no record.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetweave.storage import materialize, scratch_path

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RADIX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
ID = "urn:page:"
LEAST_BYTES = 0


def sha1_base32(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of a text's bytes: 5 hex digits are 4 of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), RADIX32, BASE32)


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds record_type and refers_to: of equal payloads the smallest id is the response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("same", F.sha2("payload", 256))
    # Written, so that the join below reads two plain tables and can split a digest that many pages share.
    firsts = materialize(rows.groupBy("same").agg(F.min("page_id").alias("first")), "warc-firsts")
    again = (F.octet_length("payload") >= least_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(firsts, "same").select(
        "page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"))


def record_texts(records: DataFrame) -> DataFrame:
    """One text per record, without the line that ends it."""
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(F.lit(HTTP + END), F.col("payload"))).otherwise("")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    address = F.regexp_replace("url", "[\r\n]+", "%0A")
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", page("page_id")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", address)).otherwise(""),
        F.when(~response, line("WARC-Refers-To", page("refers_to"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("payload")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return records.select(F.concat(head, block).alias("value"))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, compression: str = "gzip") -> None:
    """One archive per task; every record ends with two line breaks, as the format asks."""
    texts = record_texts(with_revisits(pages, least_bytes))
    texts.write.option("lineSep", END).option("compression", compression).text(folder)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def _head(value: Column) -> Column:
    return F.substring_index(value, END, 1)


def payload_of(value: Column, length: Column) -> Column:
    """The payload of a record text without magic line: its block, less the HTTP head of a response."""
    head = _head(value)
    block = F.substring(value.cast("binary"), F.octet_length(head) + len(END) + 1, length.cast("int")).cast("string")
    http = F.octet_length(F.substring_index(block, END, 1)) + len(END)
    body = F.substring(block.cast("binary"), http + 1, F.octet_length(block)).cast("string")
    return F.when(F.upper(_field(head, "WARC-Type")) == "RESPONSE", body).otherwise(block)


def _facts(value: Column, length: Column) -> dict[str, Column]:
    head, payload = _head(value), payload_of(value, length)
    return {
        "record_type": _field(head, "WARC-Type"), "record_id": _field(head, "WARC-Record-ID"),
        "target_uri": _field(head, "WARC-Target-URI"), "refers_to": _field(head, "WARC-Refers-To"),
        "digest": _field(head, "WARC-Payload-Digest"),
        "payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": sha1_base32(payload),
    }


FACTS = ("record_type", "record_id", "target_uri", "refers_to", "digest", "payload_bytes", "payload_digest")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The archives cut at every magic line, written once, with what the header says.

    One row per cut: file, block (where its split begins), place (order within
    the split), bytes, head_bytes, length (declared, null without a whole header),
    the facts of a record that ends where the next magic line begins, and value.
    """
    read = spark.read.option("lineSep", MAGIC).text(folder)
    head = _head(F.col("value"))
    length = _field(head, "Content-Length")
    whole = (F.octet_length(head) < F.octet_length("value")) & length.rlike("^[0-9]{1,10}$")
    cut = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.octet_length("value").cast("long").alias("bytes"),
        F.octet_length(head).cast("long").alias("head_bytes"), F.when(whole, length).cast("long").alias("length"), "value")
    alone = (F.col("head_bytes") + F.col("length") + 2 * len(END)).eqNullSafe(F.col("bytes"))
    facts = _facts(F.col("value"), F.col("length"))
    cut = cut.withColumn("alone", alone).withColumns({k: F.when(F.col("alone"), v) for k, v in facts.items()})
    path = scratch_path(spark, "warc-segments")
    cut.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def with_offsets(cut: DataFrame) -> DataFrame:
    """Adds start (offset of the magic line before the segment), succ and file_bytes.

    Every byte lies in one segment of one split, so the sizes of the splits before
    it give the offset where a split begins.  What stands before the first magic
    line of a file starts at minus its length.
    """
    step = F.col("bytes") + len(MAGIC)
    splits = cut.groupBy("file", "block").agg(F.sum(step).alias("split_bytes"))
    file = Window.partitionBy("file")
    splits = splits.select(
        "file", "block", (F.sum("split_bytes").over(file) - len(MAGIC)).alias("file_bytes"),
        F.coalesce(F.sum("split_bytes").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    before = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(step).over(before), F.lit(0)) + F.col("begin") - len(MAGIC)
    succ = F.col("start") + len(MAGIC) + F.col("head_bytes") + F.col("length") + 2 * len(END)
    return cut.drop("value").join(splits, ["file", "block"]).withColumn("start", start).withColumn("succ", succ)


def reachable(candidates: DataFrame) -> DataFrame:
    """Those of (file, block, start, succ) that the chain from offset 0 visits."""
    by_block = Window.partitionBy("file", "block").orderBy("start")
    edges = candidates.select(
        "*", F.lag("succ").over(by_block).eqNullSafe(F.col("start")).alias("follows"),
        F.lead("start").over(by_block).eqNullSafe(F.col("succ")).alias("leads"))
    # Where a far edge lands, a run must begin, as it may be entered there.
    landings = edges.filter("not leads").select("file", F.col("succ").alias("start"), F.lit(True).alias("landing")).distinct()
    heads = edges.join(landings, ["file", "start"], "left").withColumn("head", (~F.col("follows") | F.col("landing").isNotNull()).cast("int"))
    nodes = materialize(heads.withColumn("run", F.sum("head").over(by_block)).drop("follows", "leads", "landing", "head"), "warc-nodes")
    runs = nodes.groupBy("file", "block", "run").agg(F.min("start").alias("at"), F.max_by("succ", "start").alias("to"))
    jump = materialize(runs, "warc-runs").select("file", "at", "to")
    found = jump.filter("at = 0").select("file", "at")
    count, known = -1, found.count()
    while known > count:
        ends = found.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        found = materialize(found.union(ends.join(jump, ["file", "at"], "left_semi")).distinct(), "warc-reached")
        further = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = materialize(jump.join(further, ["file", "to"]).select("file", "at", F.col("beyond").alias("to"))
                           .union(jump.join(further, ["file", "to"], "left_anti").select("file", "at", "to")), "warc-jumps")
        count, known = known, found.count()
    entered = runs.join(found, ["file", "at"], "left_semi").select("file", "block", "run")
    return nodes.join(entered, ["file", "block", "run"], "left_semi").drop("run")


def _owned(cut: DataFrame, spread: DataFrame) -> DataFrame:
    """Segments of records that hold magic lines: (file, owner, start, value)."""
    offsets = with_offsets(cut).select("file", "block", "place", "start")
    owner = offsets.join(spread.select("file", "start", "succ"), ["file", "start"], "left").withColumn(
        "owner", F.when(F.col("succ").isNotNull(), F.struct("start", "succ")))
    # The last owner before a segment: within its split, else the last one of an earlier split.
    ends = owner.groupBy("file", "block").agg(F.max("owner").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.max("last").over(earlier).alias("carried"))
    so_far = Window.partitionBy("file", "block").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owner = owner.withColumn("own", F.max("owner").over(so_far)).join(ends, ["file", "block"])
    owner = owner.withColumn("own", F.coalesce("own", "carried")).filter("start < own.succ")
    return cut.select("file", "place", "value").join(owner.select("file", "place", "start", F.col("own.start").alias("owner")), ["file", "place"])


def read_records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Verified records (file, start, bytes and facts), and the table of segments.

    Records free of magic lines were read in the first pass.  Others, usually
    few, are put together from their segments; a group is one record.
    """
    cut = segments(spark, folder)
    candidates = materialize(with_offsets(cut).filter("start >= 0 and length is not null and succ <= file_bytes"), "warc-candidates")
    chain = reachable(candidates.select("file", "block", "start", "succ", "alone", "head_bytes", "length", *FACTS))
    chain = materialize(chain, "warc-records")
    spread = chain.filter("not alone").select("file", "start", "succ", "head_bytes", "length")
    parts = _owned(cut, spread).groupBy("file", F.col("owner").alias("start")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    joined = spread.join(parts, ["file", "start"])
    whole = joined.select("file", "start", "succ", *(v.alias(k) for k, v in _facts(F.col("value"), F.col("length")).items()))
    return chain.filter("alone").select("file", "start", "succ", *FACTS).unionByName(whole), cut


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of ``write_warc``; a revisit gets size and digest of its response."""
    records, _ = read_records(spark, folder)
    page = lambda c: F.regexp_extract(c, rf"{ID}(-?[0-9]+)", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    rows = materialize(records.select(
        number("record_id").alias("page_id"), F.col("target_uri").alias("url"), "record_type", number("refers_to").alias("refers_to"),
        F.regexp_replace("digest", "^sha1:", "").alias("digest"), "payload_bytes", "payload_digest"), "warc-pages")
    responses = rows.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"),
                                                               F.col("payload_bytes").alias("full_bytes")).distinct()
    revisits = rows.filter("record_type = 'revisit'").join(responses, ["refers_to", "digest"], "left")
    plain = rows.filter("record_type = 'response'")
    return plain.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", "url", F.col("full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))

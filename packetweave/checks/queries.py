"""One registered query per operator, each over the whole given table.

Reports read a stored analysis: per session, table folder and settings the
packets are fitted once, and the labelled packets lie in the shared folder.
``kmeans_lloyd`` and ``flagged_packets`` fit anew on every call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetweave import schema as S
from packetweave.checks.capture_files import write_capture_files
from packetweave.checks.views import spark_packets
from packetweave.functions import predicates as P
from packetweave.functions.numbers import to_number
from packetweave.functions.text import packet_line, score_band
from packetweave.operators import combinations, pca
from packetweave.operators.features import BASIC, EXTENDED, feature_frame, scope_facts
from packetweave.operators.ranking import most_frequent_first, top_n, value_counts
from packetweave.operators.sampling import sample_exact
from packetweave.operators.scaling import z_names
from packetweave.plans import anomalies, clusters, series, traffic
from packetweave.plans.analysis import LLOYD, ML, OVERSAMPLED, RESTARTS, Analysis, AnalysisError, Settings, check_counts, fit
from packetweave.sources import catalog, sinks
from packetweave.sources import packets as readers
from packetweave.sources.captures import read_capture_records
from packetweave.storage import scratch_path
from packetweave.streaming import ListArrivals, LiveScorer, MergingRefitter, packet_stream, running_counts

CAPTURE = ("capture_id",)
KEPT = ("src_ip", "dst_ip", "protocol", "info", "packet_length")
MANY_SPLITS = 256
_fits: dict[tuple, Analysis] = {}


def _r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _key(spark: SparkSession, sf_dir: str, profile, captures: bool, options: dict) -> tuple:
    return spark.sparkContext.applicationId, sf_dir, profile.name, captures, tuple(sorted(options.items()))


def _fitted(spark: SparkSession, sf_dir: str, profile=EXTENDED, captures: bool = False, **options) -> Analysis:
    options = {"trainer": LLOYD} | options
    key = _key(spark, sf_dir, profile, captures, options)
    if key not in _fits:
        keep = KEPT if profile is BASIC else ("protocol",)
        packets = spark_packets(spark, sf_dir, captures)
        _fits[key] = fit(packets, profile=profile, by=CAPTURE if captures else (), keep=keep, **options)
    return _fits[key]


def forget_fits() -> None:
    """The next query of each kind fits anew."""
    _fits.clear()


def _ext(spark: SparkSession, sf_dir: str) -> Analysis:
    return _fitted(spark, sf_dir)


def _bas(spark: SparkSession, sf_dir: str) -> Analysis:
    return _fitted(spark, sf_dir, BASIC)


def _bas8(spark: SparkSession, sf_dir: str) -> Analysis:
    return _fitted(spark, sf_dir, BASIC, k=8)


def _ext_features(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> DataFrame:
    packets = spark_packets(spark, sf_dir, bool(by))
    return feature_frame(packets, EXTENDED, scope_facts(packets, by), by)


def _bas_features(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return feature_frame(spark_packets(spark, sf_dir), BASIC, keep=keep)


def _raw_named(packets: DataFrame) -> DataFrame:
    return packets.select(*[F.col(c).alias(raw) for raw, c in S.CANONICAL.items()])


# ---- sources ---------------------------------------------------------------

def _written(spark: SparkSession, sf_dir: str, label: str) -> str:
    """The packets as a quoted CSV list in the shared folder."""
    path = scratch_path(spark, label)
    sinks.write_packets_csv(_raw_named(spark_packets(spark, sf_dir)), path)
    return path


def scan_quoted_csv(spark, sf_dir):
    path = _written(spark, sf_dir, "csv")
    return _round(readers.read_packets(spark, path, "extended").drop("capture_id"), "timestamp")


def scan_basic_csv(spark, sf_dir):
    path = _written(spark, sf_dir, "csv")
    return _round(readers.read_packets(spark, path, "basic").drop("capture_id"), "timestamp")


def scan_ragged_csv(spark, sf_dir):
    """Even rows carry an extra field, odd rows stop after the destination."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in S.CANONICAL.values()]
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in text]
    line = F.when(F.col("frame_number") % 2 == 0, F.concat_ws(",", *quoted, F.lit('"extra"'))).otherwise(
        F.concat_ws(",", *quoted[:4])
    )
    path = scratch_path(spark, "ragged")
    # The lines are finished text: one column named like the header, no quoting.
    lines = spark_packets(spark, sf_dir).select(line.alias(",".join(S.RAW_COLUMNS)))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    read = readers.read_packets(spark, path, "extended")
    return read.select("frame_number", "src_ip", "dst_ip", "protocol", "length", "info")


def _split_bytes(spark: SparkSession, path: str) -> int:
    """Splits of 64 KB, larger ones where the files would make more than ``MANY_SPLITS`` of them."""
    listed = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    return max(1 << 16, -(-(listed or 0) // MANY_SPLITS))


def scan_multiline_csv(spark, sf_dir):
    """Info holds line breaks, doubled quotes and escapes; the files are read in many splits."""
    n = F.col("frame_number")
    tail = F.when(n % 3 == 0, F.concat(F.lit("\nsecond line, of \""), n.cast("string"), F.lit("\"\r\n\n"))).when(
        n % 3 == 1, F.lit(' "quoted"')).otherwise(F.lit(" back\\\\slash"))
    packets = spark_packets(spark, sf_dir).withColumn("info", F.concat(F.translate("info", "→", ">"), tail))
    path = scratch_path(spark, "multiline")
    sinks.write_packets_csv(_raw_named(packets), path)
    # A session of its own, as the split size is a setting of the session.
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", str(_split_bytes(spark, path)))
    other.conf.set("spark.sql.files.openCostInBytes", "4k")
    lists = readers.read_lists(other, path, "extended")
    return lists.packets.select("frame_number", "src_ip", "protocol", "length", "info")


def refused_lists(spark, sf_dir):
    """Of four captures one has another header and one a quote that never ends; the others are read."""
    path = scratch_path(spark, "mixed")
    named = _raw_named(spark_packets(spark, sf_dir)).withColumn("part", F.col("`No.`") % 4)
    for part in range(4):
        frame = named.filter(F.col("part") == part).drop("part").coalesce(1)
        frame = frame.drop("Time") if part == 2 else frame
        sinks.write_packets_csv(frame, f"{path}/part{part}")
    open_quote = F.concat_ws(",", *(F.lit(x) for x in ("9", "0", "a", "b", "TCP", "5")), F.concat(F.lit('"open'), F.col("n").cast("string")))
    counted = named.agg(F.count(F.lit(1)).alias("n")).select(open_quote.alias(",".join(S.RAW_COLUMNS)))
    counted.coalesce(1).write.mode("append").option("header", True).option("sep", "\u0001").option("quote", "").csv(f"{path}/part3")
    lists = readers.read_lists(spark, f"{path}/*", "basic", capture_by="folder")
    read = lists.packets.groupBy("capture_id").agg(F.count(F.lit(1)).alias("packets")).withColumn("reason", F.lit("read"))
    reason = F.when(F.col("reason").startswith("another header"), "header").otherwise(F.col("reason"))
    return read.unionByName(lists.refused.select("capture_id", F.lit(None).cast("long").alias("packets"), reason.alias("reason")))


def encoding_fallback(spark, sf_dir):
    path = scratch_path(spark, "latin1")
    packets = spark_packets(spark, sf_dir).withColumn("info", F.concat(F.lit("café "), F.translate("info", "→", ">")))
    writer = _raw_named(packets).write.option("header", True).option("encoding", "ISO-8859-1")
    writer.option("quoteAll", True).csv(path)
    read = readers.read_packets(spark, path, "basic")
    return read.select("frame_number", "src_ip", "dst_ip", "protocol", "length", F.translate("info", ">", "→").alias("info"))


def schema_check(spark, sf_dir):
    packets = _raw_named(spark_packets(spark, sf_dir))
    layouts = {
        "full": packets,
        "no_protocol": packets.drop("Protocol"),
        "text_only": packets.select("`No.`", "Info"),
    }
    out = None
    for name, frame in layouts.items():
        report = readers.check_columns(frame.columns)
        row = frame.agg(F.count(F.lit(1)).alias("packets")).select(
            F.lit(name).alias("layout"), F.lit(len(report.missing)).alias("missing_columns"),
            F.lit(report.status).alias("status"), "packets",
        )
        out = row if out is None else out.unionByName(row)
    return out


def rename_fill_defaults(spark, sf_dir):
    named = readers.renamed(_raw_named(spark_packets(spark, sf_dir)))
    filled = readers.with_defaults(named).na.fill({"length": 0})
    return _round(filled.withColumn("length", F.col("length").cast("double")), "timestamp")


def synthesize_sequence(spark, sf_dir):
    """A list without number and time columns; positions come from the lines."""
    path = scratch_path(spark, "unnumbered")
    ordered = spark_packets(spark, sf_dir).orderBy("frame_number")
    sinks.write_packets_csv(_raw_named(ordered).drop("No.", "Time"), path)
    read = readers.read_packets(spark, path, "extended", capture_by="folder")
    return read.select("frame_number", "timestamp", "src_ip", "info")


def first_occurrence(spark, sf_dir):
    packets = _raw_named(spark_packets(spark, sf_dir))
    repeated = packets.withColumns({
        "Source": F.concat(F.col("Source"), F.lit(",0.0.0.0")), "Destination": F.concat(F.col("Destination"), F.lit(",0.0.0.0")),
    })
    out = readers.contract(repeated.withColumn("No.", F.col("`No.`").cast("string")))
    return out.select("`No.`", "Source", "Destination", "Protocol", "Info")


def _capture_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "captures")
    packets = spark_packets(spark, sf_dir, captures=True)
    named = packets.select("capture_id", *[F.col(c).alias(raw) for raw, c in S.CANONICAL.items()])
    sinks.write_packets_csv(named, path, extension="cap", by=CAPTURE)
    return path


def capture_catalog(spark, sf_dir):
    found = catalog.capture_catalog(spark, _capture_files(spark, sf_dir))
    return found.select(
        F.regexp_extract("path", r"capture_id=([^/]+)/", 1).alias("capture_id"), "suffix", "depth", "below_limit").distinct()


def capture_facts(spark, sf_dir):
    """File facts of each capture next to the packet counts of its lists, which the default reader names by path."""
    folder = _capture_files(spark, sf_dir)
    files = catalog.capture_catalog(spark, folder)
    facts = catalog.capture_facts(files, readers.read_packets(spark, f"{folder}/*/*.cap", "extended"))
    return facts.groupBy(F.regexp_extract("path", r"capture_id=([^/]+)/", 1).alias("capture_id")).agg(
        F.sum("packets").alias("packets"), (F.min("length") > 0).alias("has_content"))


def capture_order(spark, sf_dir):
    """Captures written one after the other, as the catalogue lists them: newest first."""
    path, packets = scratch_path(spark, "ordered"), spark_packets(spark, sf_dir, captures=True)
    for name in ("cap1", "cap0", "cap2"):
        own = packets.filter(F.col("capture_id") == name)
        _raw_named(own).coalesce(1).write.option("header", True).option("extension", "pcap").csv(f"{path}/{name}")
    listed = catalog.capture_catalog(spark, path).withColumn("place", F.monotonically_increasing_id())
    placed = listed.select(F.regexp_extract("path", r"/(cap\d)/[^/]*$", 1).alias("capture_id"), "place")
    before = placed.select(F.col("place").alias("_other"))
    return placed.join(before, F.col("_other") < F.col("place"), "left").groupBy("capture_id").agg(F.count("_other").alias("newer"))


def capture_records(spark, sf_dir):
    """Packets, times and lengths of capture files, from their chains of records."""
    folder = scratch_path(spark, "pcap")
    write_capture_files(spark_packets(spark, sf_dir, captures=True), folder)
    found = read_capture_records(spark, folder)
    name = F.regexp_extract("capture_id", r"([^/]+)\.pcap$", 1).alias("capture_id")
    return found.groupBy(name).agg(
        F.count("number").alias("packets"), F.max("number").alias("last_number"), F.sum("original_length").alias("bytes"),
        F.round(F.min("timestamp"), 6).alias("first_time"), F.round(F.max("timestamp"), 6).alias("last_time"), F.count("broken").alias("broken"))


def latest_capture(spark, sf_dir):
    """Two files, written one after the other: the packets, then how many they are."""
    path, packets = scratch_path(spark, "flat"), _raw_named(spark_packets(spark, sf_dir))
    packets.coalesce(1).write.option("header", True).option("extension", "pcap").csv(path)
    counted = packets.agg(F.count(F.lit(1)).cast("string").alias("n"))
    counted.coalesce(1).write.mode("append").option("extension", "pcapng").csv(path)
    newest = catalog.latest_capture(spark, path)
    return newest.select("suffix", "depth", (F.col("length") < 20).alias("is_count"))


def multi_capture_counts(spark, sf_dir):
    """Many capture files read in one run; the folder name is the capture."""
    folder = _capture_files(spark, sf_dir)
    read = readers.read_packets(spark, f"{folder}/*/*.cap", "extended", capture_by="folder")
    named = read.withColumn("capture_id", F.regexp_replace("capture_id", "^capture_id=", ""))
    return named.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packets"), F.count_distinct("frame_number").alias("frames")
    )


def json_results(spark, sf_dir):
    path = scratch_path(spark, "json")
    sinks.write_json(_ext(spark, sf_dir), path)
    return _round(sinks.read_results(spark, path), "anomaly_score")


def csv_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    sinks.write_csv(_ext(spark, sf_dir), path)
    return _round(spark.read.option("header", True).schema(sinks.RESULTS).csv(path), "anomaly_score")


# ---- features --------------------------------------------------------------

def _ext_columns(*names: str) -> Callable:
    return lambda spark, sf_dir: _ext_features(spark, sf_dir).select("frame_number", *names)


def _bas_columns(*names: str) -> Callable:
    return lambda spark, sf_dir: _bas_features(spark, sf_dir).select("frame_number", *names)


def _flags(**expressions: Callable[[], Column]) -> Callable:
    """Row-local features need no sequence step: one scan, one projection."""
    def query(spark, sf_dir):
        packets = readers.with_defaults(spark_packets(spark, sf_dir))
        return packets.select("frame_number", *[make().alias(n) for n, make in expressions.items()])

    return query


def protocol_rank(spark, sf_dir):
    packets = spark_packets(spark, sf_dir)
    return feature_frame(packets, EXTENDED, scope_facts(packets), keep=("protocol",)).select(
        "frame_number", F.coalesce("protocol", F.lit("unknown")).alias("protocol"), "protocol_encoded"
    )


def size_class(spark, sf_dir):
    length = F.coalesce(F.col("length").cast("double"), F.lit(0.0))
    return spark_packets(spark, sf_dir).select("frame_number", *[c.alias(n) for n, c in P.size_flags(length).items()])


def numeric_coerce(spark, sf_dir):
    """Bad and exponent texts mixed into the length and frame columns."""
    frame = F.col("frame_number")
    packets = spark_packets(spark, sf_dir).select(
        "frame_number",
        F.when(frame % 3 == 0, F.concat(F.col("length").cast("string"), F.lit("d")))
        .otherwise(F.concat(F.lit(" "), F.col("length").cast("string"))).alias("length"),
        F.when(frame % 5 == 0, F.lit("NaN")).otherwise(F.concat(frame.cast("string"), F.lit("e3"))).alias("scaled"),
    )
    return packets.select("frame_number", to_number(F.col("length")).alias("length"), to_number(F.col("scaled")).alias("scaled"))


def line_text(spark, sf_dir):
    line = packet_line(F.col("protocol"), F.col("src_ip"), F.col("dst_ip"), F.col("length"), F.col("info"), 50)
    return spark_packets(spark, sf_dir).select("frame_number", line.alias("line"))


# ---- model -----------------------------------------------------------------

def zscore(spark, sf_dir):
    z = z_names(len(S.EXTENDED_FEATURES))
    return _ext(spark, sf_dir).scaled().select("packet_number", *_r6(*z))


def kmeans_lloyd(spark, sf_dir):
    model = fit(spark_packets(spark, sf_dir), trainer=LLOYD)
    return model.scored().select("packet_number", "cluster_id", *_r6("distance"))


def kmeans_lloyd_by_capture(spark, sf_dir):
    model = _fitted(spark, sf_dir, captures=True)
    return model.scored().select("capture_id", "packet_number", "cluster_id", *_r6("distance"))


def kmeans_restarts(spark, sf_dir):
    model = _fitted(spark, sf_dir, trainer=RESTARTS)
    return model.scored().select("packet_number", "cluster_id", *_r6("distance"))


def kmeans_restarts_by_capture(spark, sf_dir):
    model = _fitted(spark, sf_dir, captures=True, trainer=RESTARTS)
    return model.scored().select("capture_id", "packet_number", "cluster_id", *_r6("distance"))


def kmeans_oversampled(spark, sf_dir):
    """Start centres from a few rounds of weighted candidates."""
    model = _fitted(spark, sf_dir, trainer=OVERSAMPLED)
    return model.scored().select("packet_number", "cluster_id", *_r6("distance"))


K20 = {"trainer": RESTARTS, "k": 20, "restarts": 2}


def kmeans_k20(spark, sf_dir):
    return _fitted(spark, sf_dir, **K20).scored().select("packet_number", "cluster_id", *_r6("distance"))


def centroid_distance_k20(spark, sf_dir):
    """Distance of each packet to each of twenty centres, one row each."""
    found = _fitted(spark, sf_dir, **K20).distances()
    each = F.array(*[F.round(f"distance_{i}", 6) for i in range(20)])
    return found.select("packet_number", F.posexplode(each).alias("cluster_id", "distance"))


def kmeans_centres(spark, sf_dir):
    centres = _ext(spark, sf_dir).model.select(F.posexplode("centres").alias("cluster_id", "c"))
    return centres.select("cluster_id", *[F.round(F.col("c")[i], 6).alias(n) for i, n in enumerate(S.EXTENDED_FEATURES)])


def centroid_distance(spark, sf_dir):
    names = [f"distance_{i}" for i in range(S.DEFAULT_CLUSTERS)]
    return _ext(spark, sf_dir).distances().select("packet_number", *_r6(*names))


def _scored(spark, sf_dir) -> DataFrame:
    return _round(_ext(spark, sf_dir).scored(), "anomaly_score")


def score_stats(spark, sf_dir):
    stats = _ext(spark, sf_dir).summary().select("anomaly_statistics.*")
    return _round(stats, "mean_score", "std_score", "high_anomaly_threshold")


def flagged_packets(spark, sf_dir):
    """The flagship question: which packets stand out, and in which cluster."""
    model = fit(spark_packets(spark, sf_dir), keep=("protocol",), trainer=LLOYD)
    _fits[_key(spark, sf_dir, EXTENDED, False, {"trainer": LLOYD})] = model
    return model.scored().select("frame_number", "cluster_id", *_r6("anomaly_score"), "is_anomaly")


def analysis_summary(spark, sf_dir):
    """The nested summary laid out as item/value rows."""
    one = _ext(spark, sf_dir).summary()
    stats = ["mean_score", "std_score", "high_anomaly_threshold", "high_anomaly_count"]
    pairs = [F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in ("total_packets", "num_clusters")]
    pairs += [
        F.struct(F.lit(n).alias("item"), F.round(F.col(f"anomaly_statistics.{n}").cast("double"), 6).alias("value"))
        for n in stats
    ]
    sizes = F.transform(
        F.map_entries("cluster_sizes"), lambda e: F.struct(e["key"].alias("item"), e["value"].cast("double").alias("value"))
    )
    small = F.transform("small_clusters", lambda c: F.struct(
        F.concat(F.lit("small/"), c).alias("item"), F.element_at("cluster_sizes", c).cast("double").alias("value")))
    return one.select(F.inline(F.concat(F.array(*pairs), sizes, small)))


def summary_by_capture(spark, sf_dir):
    rows = _fitted(spark, sf_dir, captures=True).summary()
    return rows.select(
        "capture_id", F.col("total_packets").alias("packets"),
        F.round("anomaly_statistics.mean_score", 6).alias("mean_score"),
        F.round("anomaly_statistics.std_score", 6).alias("std_score"),
        F.round("anomaly_statistics.high_anomaly_threshold", 6).alias("threshold"),
        F.col("anomaly_statistics.high_anomaly_count").alias("above"),
    )


def kmeans_ml(spark, sf_dir):
    model = _fitted(spark, sf_dir, trainer=ML)
    return model.scored().select("packet_number", "cluster_id", *_r6("anomaly_score"), "is_anomaly")


# ---- reports ---------------------------------------------------------------

def protocol_counts(spark, sf_dir):
    packets = readers.with_defaults(spark_packets(spark, sf_dir))
    ranked = top_n(value_counts(packets, (), "protocol"), (), most_frequent_first("protocol"), S.RANKED_PROTOCOLS)
    return ranked.select("protocol", "packets")


def length_stats(spark, sf_dir):
    return _round(traffic.totals(spark_packets(spark, sf_dir)), "avg_length").select("avg_length", "min_length", "max_length")


def capture_rate(spark, sf_dir):
    rows = traffic.totals(spark_packets(spark, sf_dir))
    return _round(rows, "duration", "packet_rate").select("packets", "duration", "packet_rate")


def _share(column: str, top: int | None = None) -> Callable:
    return lambda spark, sf_dir: _round(traffic.shares(spark_packets(spark, sf_dir), column, top=top), "percent").select(
        column, "packets", "percent"
    )


def anomaly_reasons(spark, sf_dir):
    found = anomalies.anomalous(_ext(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))
    return _round(found, "anomaly_score").drop("score_band")


def anomaly_reasons_by_capture(spark, sf_dir):
    """The first capture has 27 protocols, the others one each per packet, so that none is common there."""
    packets = spark_packets(spark, sf_dir, captures=True)
    each = F.when(F.col("capture_id") != "cap0", F.concat(F.lit("E"), F.col("frame_number").cast("string"))).otherwise(F.col("protocol"))
    model = fit(packets.withColumn("protocol", each), by=CAPTURE, keep=("protocol",), trainer=LLOYD)
    found = anomalies.anomalous(model)
    return found.select("capture_id", "packet_number", "rare_protocol", "error_flag").filter("rare_protocol or error_flag")


def time_delta_many_captures(spark, sf_dir):
    """One unkeyed fit over captures whose numbers all start at 1."""
    packets = spark_packets(spark, sf_dir, captures=True)
    again = F.expr("(frame_number - 1) div 3 + 1")
    found = feature_frame(packets.withColumn("frame_number", again), BASIC, keep=("capture_id", "timestamp"))
    return _round(found.select("capture_id", "frame_number", "packet_number", "time_delta"), "time_delta")


def fit_with_short_captures(spark, sf_dir):
    """Captures of one or two packets are rejected; the rest is fitted."""
    packets = spark_packets(spark, sf_dir, captures=True)
    short = F.when(F.col("frame_number") <= 4, F.concat(F.lit("short"), (F.col("frame_number") % 3).cast("string"))).otherwise(F.col("capture_id"))
    model = fit(packets.withColumn("capture_id", short), by=CAPTURE, trainer=LLOYD)
    fitted = model.cluster_sizes().groupBy("capture_id").agg(F.sum("packets").alias("packets"), F.lit(True).alias("fitted"))
    return fitted.unionByName(model.rejected.select("capture_id", "packets", F.lit(False).alias("fitted")))


def stream_new_capture(spark, sf_dir):
    """The keyed model knows one capture of three; the others are scored by the pooled model."""
    packets = spark_packets(spark, sf_dir, captures=True)
    known = fit(packets.filter("capture_id = 'cap0'"), by=CAPTURE, trainer=LLOYD)
    scorer = LiveScorer(known, scratch_path(spark, "live"), fallback=_ext(spark, sf_dir))
    for folder in _in_parts(spark, sf_dir, captures=True, parts=2):
        scorer.start(packet_stream(spark, folder, captures=True), availableNow=True).awaitTermination()
    scored = scorer.results(spark)
    return scored.groupBy("capture_id", "model").agg(
        F.count("anomaly_score").alias("scored"), F.count("is_anomaly").alias("flagged"), F.count("cluster_id").alias("labelled"))


def score_cutoff_by_capture(spark, sf_dir):
    path = scratch_path(spark, "json")
    sinks.write_json(_fitted(spark, sf_dir, captures=True), path)
    kept = sinks.score_cutoff(sinks.read_results(spark, path, CAPTURE), 0.8)
    return _round(kept, "anomaly_score").drop("is_anomaly")


def long_packets(spark, sf_dir):
    packets = spark_packets(spark, sf_dir).withColumn("length", F.col("length").cast("double"))
    found = anomalies.long_packets(packets)
    return _round(found, "length_threshold").select("frame_number", "length", "length_threshold")


def long_packet_lines(spark, sf_dir):
    found = anomalies.long_packets(_bas_features(spark, sf_dir, KEPT), length="packet_length")
    return anomalies.first_lines(found, length="packet_length")


def error_packet_lines(spark, sf_dir):
    found = anomalies.error_packets(_bas_features(spark, sf_dir, KEPT))
    return anomalies.first_lines(found, width=100, length=None)


def score_cutoff(spark, sf_dir):
    path = scratch_path(spark, "json")
    sinks.write_json(_ext(spark, sf_dir), path)
    kept = sinks.score_cutoff(sinks.read_results(spark, path), 0.8)
    return _round(kept, "anomaly_score").drop("is_anomaly")


def cluster_profile(spark, sf_dir):
    """The profile laid flat: sizes, lengths, leading values and the first line."""
    rows = clusters.cluster_profile(_bas(spark, sf_dir), "packet_length")
    return rows.select(
        "cluster_id", "packets", *_r6("percent", "avg_length"), "max_length", "is_small",
        F.get("top_protocol", F.lit(0))["item"].alias("top_protocol"),
        F.get("top_src_ip", F.lit(0))["item"].alias("top_source"),
        F.get("top_dst_ip", F.lit(0))["item"].alias("top_destination"),
        F.get("samples", F.lit(0))["line"].alias("first_line"),
    )


# ---- components ------------------------------------------------------------

def feature_covariance(spark, sf_dir):
    names = list(S.EXTENDED_FEATURES)
    matrix = pca.covariance(_ext(spark, sf_dir).scaled(), z_names(len(names)))
    rows = [
        (a, b, round(float(matrix[i, j]), 6) + 0.0)
        for i, a in enumerate(names) for j, b in enumerate(names) if i <= j
    ]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, covariance double")


def pca_projection(spark, sf_dir):
    model = _ext(spark, sf_dir)
    return _round(series.projection(model, series.components(model)), "pc1", "pc2")


def pca_projection_budget(spark, sf_dir):
    model = _ext(spark, sf_dir)
    return _round(series.projection(model, series.components(model), budget=500), "pc1", "pc2")


def pca_centroids(spark, sf_dir):
    model = _ext(spark, sf_dir)
    return _round(series.projected_centres(model, series.components(model)), "pc1", "pc2")


def pca_loadings(spark, sf_dir):
    model = _ext(spark, sf_dir)
    return _round(series.loadings(model, series.components(model)), "weight", "ratio")


def pca_loadings_by_capture(spark, sf_dir):
    model = _fitted(spark, sf_dir, captures=True)
    return _round(series.loadings(model, series.components(model)), "weight", "ratio")


def pca_projection_by_capture(spark, sf_dir):
    model = _fitted(spark, sf_dir, captures=True)
    return _round(series.projection(model, series.components(model)), "pc1", "pc2")


# ---- streaming -------------------------------------------------------------

def _in_parts(spark: SparkSession, sf_dir: str, captures: bool, parts: int = 3):
    """Write the packets in frame order, part by part, into an arrival folder."""
    packets = spark_packets(spark, sf_dir, captures)
    total = packets.count()
    folder = scratch_path(spark, "arrivals")
    length = packets.withColumn("length", F.col("length").cast("double"))
    for i in range(parts):
        low, high = total * i // parts, total * (i + 1) // parts
        piece = length.filter((F.col("frame_number") > low) & (F.col("frame_number") <= high))
        piece.write.mode("append").parquet(folder)
        yield folder


def stream_score(spark, sf_dir):
    scorer = LiveScorer(_ext(spark, sf_dir), scratch_path(spark, "live"))
    for folder in _in_parts(spark, sf_dir, captures=False):
        scorer.start(packet_stream(spark, folder), availableNow=True).awaitTermination()
    return _round(scorer.results(spark), "anomaly_score").select("packet_number", "cluster_id", "anomaly_score", "is_anomaly")


def stream_score_csv(spark, sf_dir):
    """Packet lists that arrive as files, a Latin-1 and a ragged one among them."""
    arrivals, source = ListArrivals(scratch_path(spark, "lists")), scratch_path(spark, "list-arrivals")
    scorer = LiveScorer(_ext(spark, sf_dir), scratch_path(spark, "live"), lists=arrivals)
    packets = spark_packets(spark, sf_dir)
    total, n = packets.count(), F.col("frame_number")
    third = F.ceil(n * 3 / total)
    arrow = F.coalesce(F.col("info").contains("→"), F.lit(False))
    whole = F.col("src_ip").isNotNull() & F.col("protocol").isNotNull()
    parts = (
        ("plain", third == 1, {}), ("latin1", (third == 2) & ~arrow, {"encoding": "ISO-8859-1"}), ("rest", (third == 2) & arrow, {}),
        ("ragged", (third == 3) & whole, {}), ("last", (third == 3) & ~whole, {}))
    for name, own, options in parts:
        rows = packets.filter(own)
        if name == "latin1":
            rows = rows.withColumn("info", F.concat("info", F.lit(" é")))
        frame = _raw_named(rows)
        writer = frame.withColumn("more", F.lit("x")) if name == "ragged" else frame
        lines = writer.select(F.concat_ws(",", *[F.concat(F.lit('"'), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"')) for c in writer.columns]).alias(",".join(S.RAW_COLUMNS)))
        out = lines.coalesce(1).write.mode("append").option("header", True).option("sep", "\u0001").option("quote", "").options(**options)
        out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(source)
        if name in ("plain", "rest", "last"):
            scorer.start(arrivals.stream(spark, source), availableNow=True).awaitTermination()
    odd = arrivals.files(spark).agg(F.count_if("latin1").alias("latin1"), F.count_if("ragged").alias("ragged"))
    return _round(scorer.results(spark), "anomaly_score").select("packet_number", "cluster_id", "anomaly_score", "is_anomaly").crossJoin(F.broadcast(odd))


def stream_delta(spark, sf_dir):
    scorer = LiveScorer(_fitted(spark, sf_dir, captures=True), scratch_path(spark, "live"))
    for folder in _in_parts(spark, sf_dir, captures=True):
        scorer.start(packet_stream(spark, folder, captures=True), availableNow=True).awaitTermination()
    return _round(scorer.results(spark), "time_delta").select("capture_id", "frame_number", "time_delta")


def stream_refit(spark, sf_dir):
    """Centres of each stored model: a full fit by the default trainer, then a weighted step from merged state."""
    refitter = MergingRefitter(scratch_path(spark, "refit"), {"trainer": RESTARTS})
    for folder in _in_parts(spark, sf_dir, captures=False, parts=2):
        refitter.start(packet_stream(spark, folder), availableNow=True).awaitTermination()
    models = spark.read.parquet(f"{refitter.folder}/models/*").withColumn("batch_id", F.regexp_extract(F.input_file_name(), "/models/([0-9]+)/", 1).cast("long"))
    centres = models.select("batch_id", F.posexplode("centres").alias("cluster_id", "centre"))
    centres = centres.select("batch_id", "cluster_id", F.posexplode(F.arrays_zip(F.array(*[F.lit(n) for n in S.EXTENDED_FEATURES]).alias("feature"), "centre")).alias("at", "pair"))
    told = refitter.fits(spark)
    return centres.join(told, "batch_id").select(
        "batch_id", "packets_so_far", "kind", "packets_read", "cluster_id", F.col("pair.feature").alias("feature"), F.round("pair.centre", 6).alias("centre"))


def stream_counts(spark, sf_dir):
    target, state = scratch_path(spark, "counts"), scratch_path(spark, "counts-state")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    for folder in _in_parts(spark, sf_dir, captures=True):
        counted = running_counts(packet_stream(spark, folder, captures=True), CAPTURE)
        writer = counted.writeStream.outputMode("complete").foreachBatch(replace)
        writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


# ---- extension and guards --------------------------------------------------

def custom_feature(spark, sf_dir):
    model = fit(
        spark_packets(spark, sf_dir),
        extra={"info_chars": F.length(F.coalesce("info", F.lit("")))}, trainer=LLOYD,
    )
    place = model.feature_names.index("info_chars") + 1
    scaled = model.scaled(keep=("info_chars",))
    return scaled.select("packet_number", "info_chars", F.round(f"z{place}", 6).alias("z_info_chars"))


def rare_combinations(spark, sf_dir):
    """Packets with a minimal rare set of attribute values, one row per set."""
    found = combinations.rare_combinations(spark_packets(spark, sf_dir))
    return found.select("frame_number", F.explode("reasons").alias("reason"))


def guards(spark, sf_dir):
    """What the guards of the analysis and of the readers say about each capture."""
    packets = spark_packets(spark, sf_dir, captures=True)
    facts = scope_facts(packets, CAPTURE)
    most = facts.agg(F.max("total")).first()[0]
    short = check_counts(facts, Settings(by=CAPTURE, minimum_packets=most))
    try:
        check_counts(facts, Settings(by=CAPTURE, minimum_packets=most + 1))
        refused = False
    except AnalysisError:
        refused = True
    readers.require_packets(packets, 1)
    marked = facts.select("capture_id", F.col("total").alias("packets")).join(short.select("capture_id", F.lit(True).alias("short")), "capture_id", "left")
    return marked.select("capture_id", "packets", F.coalesce("short", F.lit(False)).alias("is_short"), F.lit(refused).alias("refused_above"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    text, protocol = lambda: F.col("info"), lambda: F.col("protocol")
    return {
        "scan_quoted_csv": scan_quoted_csv,
        "scan_basic_csv": scan_basic_csv,
        "scan_ragged_csv": scan_ragged_csv, "scan_multiline_csv": scan_multiline_csv, "refused_lists": refused_lists,
        "encoding_fallback": encoding_fallback,
        "schema_check": schema_check,
        "rename_fill_defaults": rename_fill_defaults,
        "synthesize_sequence": synthesize_sequence,
        "first_occurrence": first_occurrence,
        "capture_catalog": capture_catalog,
        "latest_capture": latest_capture,
        "multi_capture_counts": multi_capture_counts,
        "json_results": json_results,
        "csv_results": csv_results,
        "length_numeric": _flags(length=lambda: number("length")),
        "protocol_rank": protocol_rank,
        "time_normalized": lambda s, d: _round(_ext_columns("time_normalized")(s, d), "time_normalized"),
        "ip_locality_ext": _flags(src_local=lambda: P.local_extended(F.col("src_ip")), dst_local=lambda: P.local_extended(F.col("dst_ip"))),
        "port_info": _flags(has_port_info=lambda: P.port_info(text())),
        "error_flag_ext": _flags(has_error=lambda: P.error_extended(text())),
        "protocol_flags": _flags(
            is_tcp=lambda: P.protocol_is(protocol(), "TCP"), is_udp=lambda: P.protocol_is(protocol(), "UDP"),
            is_http=lambda: P.http(protocol()), is_dns=lambda: P.protocol_is(protocol(), "DNS"),
        ),
        "size_class": size_class,
        "features_ext": lambda s, d: _round(_ext_features(s, d), "time_normalized", "time_delta"),
        "features_ext_by_capture": lambda s, d: _round(_ext_features(s, d, CAPTURE), "time_normalized", "time_delta"),
        "ip_locality_basic": _flags(src_local=lambda: P.local_basic(F.col("src_ip")), dst_local=lambda: P.local_basic(F.col("dst_ip"))),
        "protocol_num": _flags(protocol_num=lambda: P.protocol_number(protocol())),
        "numeric_coerce": numeric_coerce,
        "info_flags_basic": _flags(
            has_error=lambda: P.error_basic(text()), is_syn=lambda: P.syn(text()),
            is_fin=lambda: P.fin(text()), is_dns=lambda: P.dns_text(text()),
        ),
        "features_basic": lambda s, d: _round(_bas_features(s, d), "time_delta"),
        "packet_line": line_text,
        "score_band": lambda s, d: _ext(s, d).scored().select("packet_number", score_band(F.col("anomaly_score")).alias("score_band")),
        "time_delta_ext": lambda s, d: _round(_ext_columns("time_delta")(s, d), "time_delta"),
        "time_delta_basic": lambda s, d: _round(_bas_columns("time_delta")(s, d), "time_delta"),
        "protocol_counts": protocol_counts,
        "protocol_distribution": _share("protocol"),
        "length_stats": length_stats,
        "capture_rate": capture_rate,
        "top_sources_exact_summary": lambda s, d: _round(traffic.top_shares(spark_packets(s, d), "src_ip"), "percent").select("src_ip", "packets", "percent"),
        "top_sources": _share("src_ip", 5),
        "top_destinations": _share("dst_ip", 5),
        "traffic_summary": lambda s, d: _round(traffic.traffic_summary(spark_packets(s, d)), "value"),
        "zscore": zscore,
        "kmeans_lloyd": kmeans_lloyd,
        "kmeans_lloyd_by_capture": kmeans_lloyd_by_capture,
        "kmeans_restarts": kmeans_restarts,
        "kmeans_oversampled": kmeans_oversampled,
        "kmeans_k20": kmeans_k20,
        "centroid_distance_k20": centroid_distance_k20,
        "kmeans_restarts_by_capture": kmeans_restarts_by_capture,
        "kmeans_centres": kmeans_centres,
        "centroid_distance": centroid_distance,
        "score_minmax": lambda s, d: _scored(s, d).select("packet_number", "anomaly_score"),
        "score_stats": score_stats,
        "high_anomalies": lambda s, d: _round(anomalies.high_anomalies(_ext(s, d)), "anomaly_score").select(
            "packet_number", "cluster_id", "anomaly_score"),
        "flagged_packets": flagged_packets,
        "analysis_summary": analysis_summary,
        "summary_by_capture": summary_by_capture,
        "cluster_sizes": lambda s, d: _round(_bas(s, d).cluster_sizes(), "percent").drop("total"),
        "small_clusters": lambda s, d: _round(anomalies.small_clusters(_bas8(s, d)), "percent"),
        "cluster_length": lambda s, d: _round(
            clusters.cluster_lengths(_bas(s, d).packets, length="packet_length"), "avg_length").drop("packets"),
        "cluster_protocols": lambda s, d: clusters.cluster_protocols(_bas(s, d).packets),
        "cluster_top3": lambda s, d: _round(clusters.cluster_top(_bas(s, d)), "percent"),
        "cluster_samples": lambda s, d: clusters.cluster_samples(_bas(s, d).packets, length="packet_length"),
        "cluster_members": lambda s, d: anomalies.cluster_members(_bas(s, d), 1).select("packet_number", "cluster_id"),
        "cluster_profile": cluster_profile,
        "small_cluster_packets": lambda s, d: anomalies.in_small_cluster(_bas8(s, d)).select("packet_number", "cluster_id"),
        "small_cluster_samples": lambda s, d: anomalies.small_cluster_samples(_bas8(s, d), "packet_length"),
        "long_packets": long_packets,
        "long_packet_lines": long_packet_lines,
        "error_packets": lambda s, d: anomalies.error_packets(_bas_features(s, d, ("protocol", "info"))).select(
            "packet_number", "protocol", "info"),
        "error_packet_lines": error_packet_lines,
        "anomaly_reasons": anomaly_reasons,
        "anomaly_reasons_by_capture": anomaly_reasons_by_capture,
        "time_delta_many_captures": time_delta_many_captures,
        "fit_with_short_captures": fit_with_short_captures,
        "stream_new_capture": stream_new_capture,
        "score_cutoff_by_capture": score_cutoff_by_capture,
        "capture_facts": capture_facts, "capture_order": capture_order, "capture_records": capture_records,
        "score_cutoff": score_cutoff,
        "anomaly_report": lambda s, d: _round(anomalies.anomaly_report(_bas8(s, d), "packet_length"), "avg_length"),
        "feature_importance": lambda s, d: _round(series.feature_importance(_ext(s, d)), "importance"),
        "score_histogram": lambda s, d: _round(series.score_histogram(_ext(s, d)), "bin_start", "bin_end", "threshold"),
        "score_timeline": lambda s, d: _round(series.score_timeline(_ext(s, d)), "anomaly_score", "threshold"),
        "length_vs_score": lambda s, d: _round(series.length_against_score(_ext(s, d)), "anomaly_score"),
        "kmeans_ml": kmeans_ml,
        "feature_covariance": feature_covariance,
        "pca_projection": pca_projection,
        "pca_projection_budget": pca_projection_budget,
        "pca_centroids": pca_centroids,
        "pca_loadings": pca_loadings,
        "pca_loadings_by_capture": pca_loadings_by_capture,
        "pca_projection_by_capture": pca_projection_by_capture,
        "sample_exact": lambda s, d: sample_exact(spark_packets(s, d), 1000, ["frame_number"]).select("frame_number", "protocol"),
        "stream_score": stream_score,
        "stream_delta": stream_delta,
        "stream_refit": stream_refit,
        "stream_score_csv": stream_score_csv,
        "stream_counts": stream_counts,
        "custom_feature": custom_feature,
        "rare_combinations": rare_combinations,
        "guards": guards,
    }

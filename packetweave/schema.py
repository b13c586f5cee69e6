"""Column contract of the packet list and the fixed values of the two profiles."""

from __future__ import annotations

from pyspark.sql import types as T

# The column that names the capture of a packet.
CAPTURE = "capture_id"

# Packet-list header and canonical names.
CANONICAL = {
    "No.": "frame_number",
    "Time": "timestamp",
    "Source": "src_ip",
    "Destination": "dst_ip",
    "Protocol": "protocol",
    "Length": "length",
    "Info": "info",
}
RAW_COLUMNS = list(CANONICAL)
REQUIRED_COLUMNS = ["No.", "Time", "Source", "Destination", "Protocol"]

# Texts that a CSV read treats as missing (pandas' documented list).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Defaults for missing fields.
FILL_DEFAULTS = {"src_ip": "unknown", "dst_ip": "unknown", "protocol": "unknown", "info": ""}

# Patterns of the extended profile.
EXT_LOCAL = r"^(192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
EXT_PORT = r"\d+ →"
EXT_ERROR = r"(?i)error|failed|timeout|unreachable"

# Patterns and protocol numbers of the basic profile.
BASIC_LOCAL = r"^(10\.|172\.16\.|192\.168\.)"
BASIC_ERROR = r"error|reset|refused|failed|timeout"
BASIC_DNS = r"Standard query|response"
PROTOCOL_NUMBERS = {
    "TCP": 1, "UDP": 2, "ICMP": 3, "HTTP": 4, "HTTPS": 5, "DNS": 6,
    "TLS": 7, "TLSv1.2": 7, "TLSv1.3": 7,
}

# Limits, shares and defaults of the analysis.
RANKED_PROTOCOLS = 20
UNRANKED = 999
SMALL_BYTES, LARGE_BYTES = 100, 1000
SMALL_CLUSTER_SHARE = 0.05
RARE_PROTOCOL_SHARE = 0.01
LONG_PACKET_QUANTILE = 0.995
DEFAULT_CLUSTERS = 5
DEFAULT_SEED = 42
DEFAULT_RESTARTS = 10
DEFAULT_PERCENTILE = 90.0
HISTOGRAM_BINS = 30
CAPTURE_SUFFIXES = ["pcap", "pcapng", "cap"]
CAPTURE_LIMIT_BYTES = 100 * 1024 * 1024
STREAM_MINIMUM, STREAM_REFIT_EVERY = 100, 500

# Features of the two profiles, in their order.
EXTENDED_FEATURES = [
    "length", "protocol_encoded", "time_normalized", "time_delta",
    "src_local", "dst_local", "has_port_info", "has_error",
    "is_tcp", "is_udp", "is_http", "is_dns",
    "size_small", "size_medium", "size_large",
]
BASIC_FEATURES = [
    "Length", "time_delta", "src_local", "dst_local", "protocol_num",
    "has_error", "is_syn", "is_fin", "is_dns",
]

PACKETS = T.StructType([
    T.StructField("frame_number", T.LongType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("length", T.DoubleType()),
    T.StructField("info", T.StringType()),
])

import pytest
from pyspark.sql import functions as F

from packetweave.functions import predicates as P
from packetweave.functions.numbers import to_number
from packetweave.functions.text import packet_line, score_band


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    found = rows.select("i", expression(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(found, key=lambda r: r["i"])]


ADDRESSES = ["10.0.0.1", "192.168.1.9", "172.16.0.1", "172.20.1.1", "172.32.0.1", "8.8.8.8", "unknown", None]


@pytest.mark.parametrize("predicate, values, expected", [
    (P.local_extended, ADDRESSES, [1, 1, 1, 1, 0, 0, 0, 0]),
    (P.local_basic, ADDRESSES, [1, 1, 1, 0, 0, 0, 0, 0]),
    (P.error_extended, ["Timeout", "Connection reset", "refused", "Destination unreachable", None, ""], [1, 0, 0, 1, 0, 0]),
    (P.error_basic, ["Timeout", "Connection reset", "refused", "Destination unreachable", None, ""], [1, 1, 1, 0, 0, 0]),
    (lambda c: P.protocol_is(c, "TCP"), ["TCP", "tcp", "HTTP/2", None], [1, 1, 0, 0]),
    (P.http, ["TCP", "HTTP/2", "http", None], [0, 1, 0, 0]),
    (P.protocol_number, ["TCP", "tcp", "HTTP/2", "TLSv1.3", "DNS", None], [1, 0, 0, 7, 6, 0]),
    (P.syn, ["[SYN] Seq=0", "[SYN, ACK]", "[FIN, ACK]", None], [1, 0, 0, 0]),
    (P.fin, ["[SYN] Seq=0", "[SYN, ACK]", "[FIN, ACK]", None], [0, 0, 1, 0]),
    (P.dns_text, ["Standard query A", "a response", "Response", None], [1, 1, 0, 0]),
    (P.port_info, ["5000 → 80", "→ 80", "5000→80", None], [1, 0, 0, 0]),
])
def test_predicates(spark, predicate, values, expected):
    assert column(spark, values, predicate) == expected


def test_number_parsing(spark):
    texts = ["1e3", " 12 ", "-4.5", ".5", "x", "1d", "0x1A", "1,000", "NaN", "inf", "1e999", "", None]
    assert column(spark, texts, to_number) == [1000.0, 12.0, -4.5, 0.5] + [None] * 9


@pytest.mark.parametrize("length, expected", [(99, (1, 0, 0)), (100, (0, 1, 0)), (999, (0, 1, 0)), (1000, (0, 0, 1))])
def test_size_classes(spark, length, expected):
    row = spark.range(1).select(*[c.alias(n) for n, c in P.size_flags(F.lit(length)).items()]).first()
    assert tuple(row) == expected


def test_text(spark):
    row = spark.range(1).select(
        packet_line(F.lit("TCP"), F.lit(None), F.lit("b"), F.lit(60), F.lit("x" * 80), 50).alias("a"),
        packet_line(F.lit("TCP"), F.lit("a"), F.lit("b"), F.lit(60.0), F.lit("x"), 50).alias("f"),
        packet_line(F.lit("TCP"), F.lit("a"), F.lit("b"), None, F.lit(None), 100).alias("b"),
        score_band(F.lit(0.29)).alias("c"), score_band(F.lit(0.3)).alias("d"), score_band(F.lit(0.7)).alias("e"),
    ).first()
    assert row["a"] == "TCP nan -> b (60 bytes): " + "x" * 50 + "..."
    assert row["f"] == "TCP a -> b (60 bytes): x..."
    assert row["b"] == "TCP a -> b: ..."
    assert (row["c"], row["d"], row["e"]) == ("low", "medium", "high")

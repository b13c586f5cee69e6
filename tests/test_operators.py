import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from packetweave import storage
from packetweave.checks.views import spark_packets
from packetweave.operators.features import EXTENDED, feature_frame, scope_facts
from packetweave.operators.quantile import quantile_rows
from packetweave.operators.sampling import sample_exact
from packetweave.operators.sequence import delta, with_sequence


@pytest.mark.parametrize("by", [(), ("capture_id",)])
@pytest.mark.parametrize("width", [7, 100, 1 << 16])
def test_sequence_equals_a_global_window(spark, small, by, width):
    packets = spark_packets(spark, small, captures=True).filter("frame_number % 11 != 3").repartition(5)
    whole = Window.partitionBy(*by).orderBy("frame_number")
    expected = packets.select(
        "frame_number", F.row_number().over(whole).cast("long").alias("n"),
        F.coalesce(F.col("timestamp") - F.lag("timestamp").over(whole), F.lit(0.0)).alias("d"),
    )
    found = with_sequence(packets, F.col("timestamp"), by, bucket_frames=width).select(
        "frame_number", F.col("packet_number").alias("n"), delta(F.col("timestamp")).alias("d")
    )
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_missing_values_in_the_sequence(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, 9.0)], "frame_number long, t double")
    for width in (1, 2, 10):
        found = with_sequence(rows, F.col("t"), bucket_frames=width).select("frame_number", delta(F.col("t")).alias("d"))
        assert [r["d"] for r in found.orderBy("frame_number").collect()] == [0.0, 0.0, 0.0, 2.0]


def test_sequence_continues_a_seed(spark):
    rows = spark.createDataFrame([(4, 9.0), (5, 10.0)], "frame_number long, t double")
    seed = spark.createDataFrame([(3, 7.0)], "seed_rows long, seed_value double")
    found = with_sequence(rows, F.col("t"), seed=seed).select("packet_number", delta(F.col("t")).alias("d"))
    assert [tuple(r) for r in found.orderBy("packet_number").collect()] == [(4, 2.0), (5, 1.0)]


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.995, 1.0])
def test_quantile_matches_linear_interpolation(spark, q):
    draw = random.Random(7)
    groups = {"hot": [draw.gauss(0, 5) for _ in range(3000)], "tied": [1.0] * 500 + [2.0] * 40, "one": [3.5]}
    rows = [(g, i, v) for g, values in groups.items() for i, v in enumerate(values)] + [("empty", 0, None)]
    df = spark.createDataFrame(rows, "g string, frame_number int, v double").repartition(6)
    # Few bins take several rounds; the result stays exact.
    found = {r["g"]: r["quantile"] for r in quantile_rows(df, "v", q, ("g",), bins=20).collect()}
    assert found.pop("empty", None) is None
    for g, values in groups.items():
        assert found[g] == pytest.approx(np.quantile(values, q), abs=1e-12)
    only = df.filter("g = 'hot'")
    assert quantile_rows(only, "v", q).first()["quantile"] == pytest.approx(np.quantile(groups["hot"], q), abs=1e-12)


@pytest.mark.parametrize("q", [0.05, 0.5, 0.9, 0.999])
def test_brackets_are_narrowed(spark, q):
    draw = random.Random(3)
    values = [draw.gauss(0, 5) for _ in range(4000)] + [1.25] * 900
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "frame_number int, v double")
    found = quantile_rows(df, "v", q, bins=3).first()["quantile"]
    assert found == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_a_dominant_capture_and_far_ends(spark):
    """One scope holds nearly all rows; another spans the whole range of doubles."""
    rows = spark.range(40_000).select(F.lit("hot").alias("g"), F.col("id").cast("int").alias("frame_number"), F.sqrt("id").alias("v"))
    far = [1e308, -1e308, 1.0, 2.0, 3.0, 1e-300, 0.0]
    rows = rows.union(spark.createDataFrame([("far", i, v) for i, v in enumerate(far)], "g string, frame_number int, v double"))
    found = {r["g"]: r["quantile"] for r in quantile_rows(rows, "v", 0.5, ("g",)).collect()}
    assert found == {"hot": pytest.approx(np.median(np.sqrt(np.arange(40_000)))), "far": 1.0}


def test_seventeen_scores(spark):
    df = spark.range(17).select((F.col("id") / 16.0).alias("v"))
    cut = quantile_rows(df, "v", 0.9).first()["quantile"]
    assert cut == pytest.approx(0.9)
    assert df.filter(F.col("v") > cut).count() == 2


@pytest.mark.parametrize("size", [0, 1, 37, 999, 1000, 5000])
def test_exact_sample(spark, small, size):
    packets = spark_packets(spark, small)
    first = sample_exact(packets, size, ["frame_number"])
    numbers = {r[0] for r in first.select("frame_number").collect()}
    assert len(numbers) == min(size, 1000)
    again = sample_exact(packets.repartition(7), size, ["frame_number"])
    assert numbers == {r[0] for r in again.select("frame_number").collect()}


def test_salted_attach_equals_broadcast(spark, small):
    packets = spark_packets(spark, small, captures=True)
    by = ("capture_id",)
    rows = storage.freeze(packets.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by, "t")
    plain = storage.attach(packets, rows, by).select("frame_number", "n")
    salted = storage.attach(packets, rows, by, limit=0).select("frame_number", "n")
    assert plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()
    assert salted.count() == 1000


def test_short_captures_divide_by_one_second(spark):
    rows = [(i + 1, t, "a", "b", "TCP", 60.0, "") for i, t in enumerate([0.0, 0.25, 0.5])]
    df = spark.createDataFrame(
        rows, "frame_number long, timestamp double, src_ip string, dst_ip string, protocol string, length double, info string"
    )
    found = feature_frame(df, EXTENDED, scope_facts(df)).orderBy("frame_number").collect()
    assert [r["time_normalized"] for r in found] == [0.0, 0.25, 0.5]
    assert [r["time_delta"] for r in found] == [0.0, 0.25, 0.25]


def test_no_packet_sized_single_partition(spark, small):
    """Only the bucket table, the protocol table and scope rows may meet in one task."""
    packets = spark_packets(spark, small)
    frame = feature_frame(packets, EXTENDED, scope_facts(packets))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    for i in single:
        assert any("Aggregate" in line for line in lines[i + 1 : i + 3]), plan


def test_many_small_captures_spread_over_tasks(spark):
    """A thousand captures of ten packets: each starts anew, and no partition holds them all."""
    rows = spark.range(10_000).select(
        F.concat(F.lit("c"), F.format_string("%04d", F.col("id") % 1000)).alias("capture_id"), F.expr("id div 1000 + 1").alias("frame_number"),
        F.expr("cast(id % 1000 + id div 1000 as double)").alias("timestamp"))
    found = with_sequence(rows, F.col("timestamp"), within=("capture_id",))
    assert found.filter("frame_number = 1 and _previous is not null").count() == 0
    assert found.filter("frame_number > 1 and timestamp - _previous <> 1").count() == 0
    place = (F.substring("capture_id", 2, 4).cast("int") * 10 + F.col("frame_number")) == F.col("packet_number")
    assert found.filter(~place).count() == 0
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 5000

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetweave import AnalysisError, BASIC, EXTENDED, fit, load
from packetweave.checks.views import spark_packets
from packetweave.operators import kmeans, restarts
from packetweave.operators.scaling import z_names
from packetweave.plans import anomalies, clusters, series
from packetweave.plans.analysis import LLOYD, ML, RESTARTS
from packetweave.storage import scratch_path


@pytest.fixture(scope="module")
def single(spark, small):
    return fit(spark_packets(spark, small), keep=("protocol",), trainer=LLOYD)


@pytest.fixture(scope="module")
def keyed(spark, small):
    return fit(spark_packets(spark, small, captures=True), by=("capture_id",), trainer=LLOYD, iterations=4)


def matrix(analysis, extra=()):
    names = z_names(len(analysis.feature_names))
    rows = analysis.scaled(keep=extra).orderBy("packet_number").collect()
    return np.array([[r[n] for n in names] for r in rows]), rows


def brute_lloyd(z, k, iterations):
    n = len(z)
    centres = np.round(z[[int(np.floor((i + 0.5) * n / k)) for i in range(k)]], 9)
    for _ in range(iterations):
        label = ((z[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for i in range(k):
            if (label == i).any():
                centres[i] = np.round(z[label == i].mean(0), 9)
    distance = ((z[:, None, :] - centres[None]) ** 2).sum(2)
    return centres, distance.argmin(1), np.sqrt(distance.min(1))


def test_z_scores_have_unit_spread(single):
    z, _ = matrix(single)
    assert np.allclose(z.mean(0), 0, atol=1e-9)
    spread = z.std(0)
    assert np.all(np.isclose(spread, 1) | np.isclose(spread, 0))


def test_lloyd_equals_brute_force(single):
    z, _ = matrix(single)
    centres, label, distance = brute_lloyd(z, 5, 10)
    rows = single.scored().orderBy("packet_number").collect()
    assert [r["cluster_id"] for r in rows] == label.tolist()
    assert np.allclose([r["distance"] for r in rows], distance, atol=1e-7)
    score = (distance - distance.min()) / (distance.max() - distance.min())
    assert np.allclose([r["anomaly_score"] for r in rows], score, atol=1e-7)
    assert [r["is_anomaly"] for r in rows] == (distance > np.percentile(distance, 90)).tolist()
    stats = single.summary().first()["anomaly_statistics"]
    assert stats["mean_score"] == pytest.approx(score.mean(), abs=1e-7)
    assert stats["std_score"] == pytest.approx(score.std(), abs=1e-7)
    assert stats["high_anomaly_threshold"] == pytest.approx(np.percentile(score, 90), abs=1e-7)
    assert stats["high_anomaly_count"] == int((distance > np.percentile(distance, 90)).sum())


def test_keyed_fit_equals_one_fit_per_capture(spark, small, keyed):
    packets = spark_packets(spark, small, captures=True)
    alone = fit(packets.filter("capture_id = 'cap1'"), trainer=LLOYD, iterations=4)
    expected = alone.scored().select("frame_number", "packet_number", "cluster_id", F.round("anomaly_score", 8), "is_anomaly")
    found = keyed.scored().filter("capture_id = 'cap1'").select(
        "frame_number", "packet_number", "cluster_id", F.round("anomaly_score", 8), "is_anomaly"
    )
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_many_captures_path_gives_the_same_centres(spark, keyed):
    """Above the broadcast bound the centres stay in a table and joins are salted."""
    start = keyed.model.select("capture_id", "means", "scales", "centres")
    names = keyed.feature_names
    few = kmeans.lloyd(keyed.packets, names, start, ("capture_id",), 5, 2)
    many = kmeans.lloyd(keyed.packets, names, start, ("capture_id",), 5, 2, limit=0)
    left = {r["capture_id"]: np.array(r["centres"]) for r in few.collect()}
    right = {r["capture_id"]: np.array(r["centres"]) for r in many.collect()}
    assert left.keys() == right.keys()
    for name in left:
        assert np.allclose(left[name], right[name], atol=1e-8)


def test_restarts_of_many_captures_give_the_same_centres(keyed):
    scale = keyed.model.select("capture_id", "means", "scales")
    few, many = (
        restarts.restarted(keyed.packets, keyed.feature_names, scale, ("capture_id",), 3, 2, 42, limit=limit, steps=3) for limit in (None, 0))
    left = {r["capture_id"]: np.array(r["centres"]) for r in few.collect()}
    right = {r["capture_id"]: np.array(r["centres"]) for r in many.collect()}
    assert left.keys() == right.keys() and len(left) == 3
    for name in left:
        assert np.allclose(left[name], right[name], atol=1e-8)


def test_restarts_find_separate_groups(spark):
    """Three far groups of lengths: every packet ends with those of its own group."""
    rows = [(i + 1, 0.0, "a", "b", "TCP", float((1, 500, 2000)[i % 3] + i % 2), "x") for i in range(60)]
    df = spark.createDataFrame(
        rows, "frame_number long, timestamp double, src_ip string, dst_ip string, protocol string, length double, info string")
    found = fit(df, k=3, restarts=3).scored().select("packet_number", "cluster_id").collect()
    assert len({((r["packet_number"] - 1) % 3, r["cluster_id"]) for r in found}) == 3
    assert len({r["cluster_id"] for r in found}) == 3


def test_saved_model_scores_the_same(spark, single):
    path = scratch_path(spark, "saved")
    single.save(path)
    again = load(spark, path)
    features = single.packets.drop("cluster_id", "distance")
    left = single.scored().select("packet_number", "cluster_id", F.round("anomaly_score", 9)).collect()
    right = again.scored(features).select("packet_number", "cluster_id", F.round("anomaly_score", 9)).collect()
    assert sorted(map(tuple, left)) == sorted(map(tuple, right))


def test_ml_restarts(spark, small):
    packets = spark_packets(spark, small)
    model = fit(packets, trainer=ML, restarts=2, profile=BASIC, k=4)
    rows = model.scored().collect()
    assert 0 <= min(r["anomaly_score"] for r in rows) and max(r["anomaly_score"] for r in rows) <= 1
    near = model.distances().collect()
    for r in near:
        assert r["distance"] == pytest.approx(min(r[f"distance_{i}"] for i in range(4)))
    ml_cost = sum(r["distance"] ** 2 for r in rows)
    plain = fit(packets, profile=BASIC, k=4, trainer=LLOYD)
    assert ml_cost <= sum(r["distance"] ** 2 for r in plain.scored().collect()) * 1.05


def test_identical_packets_have_no_anomalies(spark):
    rows = [(i + 1, 0.0, "a", "b", "TCP", 60.0, "x") for i in range(20)]
    df = spark.createDataFrame(
        rows, "frame_number long, timestamp double, src_ip string, dst_ip string, protocol string, length double, info string"
    )
    for options in ({"trainer": LLOYD}, {"trainer": ML, "restarts": 1}, {"trainer": RESTARTS, "restarts": 2}):
        model = fit(df, k=3, **options)
        assert model.scored().filter("is_anomaly").count() == 0
        summary = model.summary().first()
        assert (summary["num_clusters"], summary["cluster_count"]) == (3, 1)
        assert {r["anomaly_score"] for r in model.scored().collect()} == {0.0}
        assert series.score_histogram(model).agg(F.sum("packets")).first()[0] == 20


def test_small_cluster_share(spark, single):
    sizes = {"cluster_0": 4, "cluster_1": 5, "cluster_2": 91}
    model = single.model.withColumn("sizes", F.expr("array(4L, 5L, 91L)")).withColumn("total", F.lit(100).cast("long"))
    changed = type(single)(single.settings, single.feature_names, model, single.packets)
    summary = changed.summary().first()
    assert summary["cluster_sizes"] == sizes
    assert summary["small_clusters"] == ["cluster_0"]


def test_components(single):
    z, _ = matrix(single)
    found = series.components(single)
    w = np.array(found.loadings)
    assert np.allclose(w @ w.T, np.eye(2), atol=1e-9)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T, bias=True)))[::-1]
    assert np.allclose(found.ratios, values[:2] / values.sum(), atol=1e-9)
    points = series.projection(single, found).orderBy("packet_number").collect()
    assert np.allclose([[r["pc1"], r["pc2"]] for r in points], z @ w.T, atol=1e-7)
    assert series.projected_centres(single, found).count() == 5
    assert series.loadings(single, found).count() == 10


def test_guards(spark, small):
    packets = spark_packets(spark, small)
    with pytest.raises(AnalysisError):
        fit(packets.limit(3))
    with pytest.raises(AnalysisError):
        fit(packets.filter("false"))
    with pytest.raises(AnalysisError):
        fit(packets, k=25, k_range=(2, 20))
    with pytest.raises(AnalysisError):
        fit(packets, k=0)
    with pytest.raises(AnalysisError):
        fit(packets, minimum_packets=100_000)


def test_threshold_is_a_parameter(spark, small):
    model = fit(spark_packets(spark, small), percentile=50, trainer=LLOYD, iterations=1)
    assert model.scored().filter("is_anomaly").count() == pytest.approx(500, abs=5)


def test_reports_cover_all_packets(spark, small):
    model = fit(
        spark_packets(spark, small), profile=BASIC, trainer=LLOYD, iterations=2,
        keep=("src_ip", "dst_ip", "protocol", "info", "packet_length"),
    )
    profile = clusters.cluster_profile(model, "packet_length").collect()
    assert sum(r["packets"] for r in profile) == 1000
    assert all(len(r["top_protocol"]) <= 3 and len(r["samples"]) <= 2 for r in profile)
    listed = anomalies.reasons(model).collect()
    assert len(listed) == 1000
    for r in listed:
        assert ("error_flag" in r["reasons"]) == r["error_flag"]


def test_results_do_not_depend_on_partitioning(spark, small, single):
    shuffled = fit(spark_packets(spark, small).repartition(13), trainer=LLOYD)
    left = single.scored().select("packet_number", "cluster_id", F.round("anomaly_score", 7)).collect()
    right = shuffled.scored().select("packet_number", "cluster_id", F.round("anomaly_score", 7)).collect()
    assert sorted(map(tuple, left)) == sorted(map(tuple, right))


def test_short_captures_are_rejected_and_the_rest_is_fitted(spark, small):
    packets = spark_packets(spark, small, captures=True)
    short = F.when(F.col("frame_number") == 7, F.lit("tiny")).otherwise(F.col("capture_id"))
    model = fit(packets.withColumn("capture_id", short), by=("capture_id",), trainer=LLOYD, iterations=1)
    assert [tuple(r) for r in model.rejected.collect()] == [("tiny", 1, 5)]
    assert model.scored().count() == 999 and model.model.count() == 3
    with pytest.raises(AnalysisError):
        fit(packets.limit(3), by=("capture_id",))


def test_no_reason_is_lost_where_no_protocol_is_common(spark, small):
    packets = spark_packets(spark, small, captures=True).withColumn("protocol", F.concat(F.lit("P"), F.col("frame_number").cast("string")))
    model = fit(packets, by=("capture_id",), keep=("protocol",), trainer=LLOYD, iterations=1)
    assert anomalies.anomalous(model).count() == packets.count()


def test_components_per_capture_are_those_of_each_alone(spark, small, keyed):
    found = series.components(keyed)
    alone = fit(spark_packets(spark, small, captures=True).filter("capture_id = 'cap1'").drop("capture_id"), trainer=LLOYD, iterations=4)
    single = series.components(alone)
    row = found.rows.filter("capture_id = 'cap1'").first()
    assert np.allclose(row["loadings"], single.loadings, atol=1e-9) and np.allclose(row["ratios"], single.ratios, atol=1e-9)
    assert series.projected_centres(keyed, found).count() == 15
    listed = series.loadings(keyed, found, top=None).filter("capture_id = 'cap1'").drop("capture_id")
    names = ["component", "rank", "feature"]
    assert sorted(map(tuple, listed.select(names).collect())) == sorted(map(tuple, series.loadings(alone, single, top=None).select(names).collect()))

"""K-means over blocks: bounds, oversampled starts and many centres against plain forms."""

import hashlib

import numpy as np
import pytest

from packetweave import fit
from packetweave.checks.views import spark_packets
from packetweave.operators import bounded
from packetweave.operators.scaling import moments
from packetweave.plans.analysis import LLOYD, OVERSAMPLED, AnalysisError


@pytest.fixture(scope="module")
def fitted(spark, small):
    model = fit(spark_packets(spark, small), trainer=LLOYD, iterations=1)
    row = model.packets.agg(*moments(model.feature_names)).first()
    return model, row, bounded.points(model.packets, model.feature_names, row["means"], row["scales"])


def test_bounds_change_no_label_and_spare_distances(fitted):
    _, row, points = fitted
    d, told = len(row["means"]), bounded.Told()
    begun = bounded.drawn(points, d, 20, 2, 42, told)
    plain, spared = bounded.Told(), bounded.Told()
    ended = bounded.converged(points, begun, plain, bounded=False)
    assert np.array_equal(ended, bounded.converged(points, begun, spared))
    assert plain.computed == plain.asked == spared.asked and spared.tables > 0
    # Most packets of the later steps keep their label without a distance.
    assert spared.computed < 0.75 * spared.asked


def test_labels_from_old_bounds():
    """Random moves of centres, ties and an absent centre: labels as from all distances."""
    rng = np.random.default_rng(3)
    z = np.round(rng.normal(size=(2000, 3)), 1)
    base = np.vstack([np.round(rng.normal(size=(6, 3)), 1), np.full((1, 3), np.nan)])
    label, upper, lower = bounded.nearest_two(z, base)
    for size in (0.0, 0.01, 0.1, 1.0):
        centres = base + size * np.round(rng.normal(size=base.shape), 2)
        found, computed = bounded.relabelled(z, centres, base, label, upper, lower)
        assert np.array_equal(found, bounded.nearest_two(z, centres)[0])
        assert (computed < len(z) / 2) if size <= 0.01 else computed <= len(z)


def test_oversampling_takes_few_jobs_whatever_k(fitted):
    model, row, points = fitted
    d, n = len(row["means"]), model.packets.count()
    for k in (5, 20):
        few, many = bounded.Told(), bounded.Told()
        starts = bounded.oversampled(points, d, k, 3, 42, few, n)
        one_by_one = bounded.drawn(points, d, k, 3, 42, many)
        assert few.jobs == bounded.ROUNDS + 2 and many.jobs == k
        assert starts.shape == one_by_one.shape == (3, k, d) and not np.isnan(starts).any()
        costs = bounded.potentials(points, starts, few), bounded.potentials(points, one_by_one, many)
        assert sum(costs[0].values()) < 1.2 * sum(costs[1].values())


def test_weighted_draws_take_no_place_twice():
    candidates = np.array([[0.0], [0.0], [1.0], [5.0]])
    picked = bounded.weighted_draw(candidates, np.array([3, 0, 2, 1]), [0, 4, 9, 7], 5, 42, 0)
    assert sorted(picked[:3, 0]) == [0.0, 1.0, 5.0] and np.isnan(picked[3:]).all()


def test_fewer_places_than_centres(spark):
    rows = [(i, float(i), "10.0.0.1", "10.0.0.2", "TCP", 60.0 if i % 2 else 1500.0, "x") for i in range(1, 41)]
    packets = spark.createDataFrame(rows, "frame_number long, timestamp double, src_ip string, dst_ip string, protocol string, length double, info string")
    packets = packets.withColumn("timestamp", packets["timestamp"] * 0)
    for trainer in ("restarts", OVERSAMPLED):
        model = fit(packets, trainer=trainer, k=12, restarts=2)
        assert model.summary().first()["cluster_count"] == 2
        assert max(r["distance"] for r in model.packets.select("distance").collect()) < 1e-9
    with pytest.raises(AnalysisError, match="one model"):
        fit(packets, trainer=OVERSAMPLED, by=("capture_id",))


def test_many_centres_score_new_packets_alike(spark, small, tmp_path):
    from packetweave.plans.analysis import load

    packets = spark_packets(spark, small)
    model = fit(packets, k=20, trainer=OVERSAMPLED, restarts=1)
    model.save(str(tmp_path / "m"))
    names = [*model.feature_names, "packet_number", "frame_number"]
    again = load(spark, str(tmp_path / "m")).scored(model.packets.select(*dict.fromkeys(names)))
    first = {r["packet_number"]: (r["cluster_id"], r["is_anomaly"]) for r in model.scored().collect()}
    assert {r["packet_number"]: (r["cluster_id"], r["is_anomaly"]) for r in again.collect()} == first


def test_races_are_md5_of_the_packet_number():
    numbers = [0, 1, 9, 10, 12345, 10**18 - 1, 10**18, 9 * 10**18, -5, *range(1, 3000, 7)]
    for seed, run, label in ((42, 3, "r2"), (10**40, 1, "0"), (1, 1, "w" * 60)):
        heads = [int.from_bytes(hashlib.md5(f"{seed}:{run}:{label}:{n}".encode()).digest()[:8], "big") for n in numbers]
        wanted = -np.log(((np.array(heads, np.uint64) >> np.uint64(12)).astype(float) + 1.0) / float(1 << 52))
        assert (bounded.races(seed, run, label, np.array(numbers)) == wanted).all()
        assert (np.concatenate([bounded._md5_heads(bounded._blocks(b"7:", np.array([n]), len(str(n)))) for n in (0, 98765)])
                == [int.from_bytes(hashlib.md5(f"7:{n}".encode()).digest()[:8], "big") for n in (0, 98765)]).all()


def test_nearest_by_products_equals_squared_differences():
    rng = np.random.default_rng(5)
    for k in (1, 8, 9, 51):
        z, centres = rng.normal(size=(5000, 15)) * 100, rng.normal(size=(k, 15)) * 100
        z[:k] = centres
        if k > 3:
            centres[1], centres[2], centres[3] = centres[0], np.nan, centres[0] + 1e-9
        z[100], z[101, 0] = np.nan, np.inf
        found, (label, least) = bounded.squares(z, centres), bounded.nearest(z, centres)
        assert (label == found.argmin(axis=0)).all() and (least == found.min(axis=0)).all()


def test_ml_trainer_keeps_its_own_vectors(spark, monkeypatch):
    """Of a cached frame, Spark's trainer decodes every row at each step."""
    from pyspark.ml.clustering import KMeans

    from packetweave.operators import kmeans_ml

    cached, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: cached.append(rows.is_cached) or fit(self, rows))
    rows = spark.createDataFrame([(float(x), float(y)) for x in (0, 100) for y in range(10)], "a double, b double")
    centres, cost = kmeans_ml.best_centres(rows, ["a", "b"], 2, restarts=2)
    assert cached == [False, False]
    assert sorted(centres) == [[0.0, 4.5], [100.0, 4.5]] and abs(cost - 165.0) < 1e-6

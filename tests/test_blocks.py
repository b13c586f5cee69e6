"""Nearest centres and component sums over blocks against the written-out expressions."""

import random

import pytest
from pyspark.sql import functions as F

from packetweave.operators import blocks, kmeans, pca
from packetweave.operators.scaling import Terms, with_z

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def scoped(spark):
    rng = random.Random(4)
    rows = [(f"s{i % 3}" if i % 50 else None, i, float(rng.randrange(5)), rng.random(), i % 2) for i in range(1, 700)]
    features = spark.createDataFrame(rows, "scope string, packet_number long, a double, b double, c int").repartition(5)
    # s1 has an absent centre, s2 two equal ones, s3 no packets.
    centres = {"s0": [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]], "s1": [[0.5, 0.0, 1.0], None], "s2": [[0.0, 1.0, 0.0], [0.0, 1.0, 0.0]], "s3": [None, None]}
    held = [(key, [2.0, 0.5, 0.5], [1.5, 0.25, 3.0], c) for key, c in centres.items()]
    return features, spark.createDataFrame(held, f"scope string, {kmeans.TRAINED}")


def plain(features, rows):
    terms = Terms.of(rows, ("scope",), 3, 2)
    scaled = with_z(terms.place(features), NAMES, terms, ["scope", "packet_number", *terms.columns()])
    return kmeans.nearest(scaled, terms, ["scope", "packet_number", "z1", "z2", "z3"])


def test_labels_over_blocks(scoped):
    features, rows = scoped
    wanted = plain(features, rows).select("scope", "packet_number", "cluster_id", "distance")
    found = blocks.labelled(features, NAMES, rows.collect(), ("scope",), 2).select(wanted.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_steps_over_blocks(scoped):
    features, rows = scoped
    means = plain(features, rows).filter("scope is not null").groupBy("scope", "cluster_id").agg(F.array(*[F.round(F.avg(z), 9) for z in ("z1", "z2", "z3")]).alias("centre"))
    found = blocks.cluster_means(features, NAMES, rows.collect(), ("scope",), 2, 9)
    near = lambda df: {(r["scope"], r["cluster_id"]): pytest.approx(r["centre"], abs=2e-9) for r in df.collect()}
    assert {(r["scope"], r["cluster_id"]): r["centre"] for r in found.collect()} == near(means)


def test_component_sums_over_blocks(scoped):
    features, _ = scoped
    scaled = features.select("scope", F.col("a").alias("z1"), F.col("b").alias("z2"), F.col("c").cast("double").alias("z3"))
    names = ["z1", "z2", "z3"]
    wanted = {r["scope"]: pytest.approx(r["m"] + r["p"]) for r in scaled.groupBy("scope").agg(*pca._moments(names)).collect()}
    assert {r["scope"]: r["m"] + r["p"] for r in pca._scoped_moments(scaled, names, ("scope",)).collect()} == wanted


def test_runs_over_blocks(scoped):
    from packetweave.operators import restarts

    features, rows = scoped
    runs = rows.select("scope", F.explode(F.array(F.lit(0), F.lit(1))).alias(restarts.RUN), "means", "scales", "centres")
    found = restarts._measured(features, NAMES, runs, ("scope",), 2, True)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    wanted = restarts._measured(features, NAMES, runs, ("scope",), 2, False).select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))

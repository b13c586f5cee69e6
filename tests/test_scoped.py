"""Runs of few scopes over stored blocks of packets, against tables and plain distances."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetweave.operators import restarts, scoped
from packetweave.operators.scaling import ABSENT, moments

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def keyed(spark):
    """Three scopes with many ties, one of two places only, and packets without a scope."""
    rng = random.Random(6)
    rows = [(f"s{i % 3}" if i % 40 else None, i, float(rng.randrange(4)), round(rng.random(), 1), i % 2) for i in range(1, 900)]
    rows += [("few", i, float(i % 2), 0.0, 1) for i in range(1, 30)]
    features = spark.createDataFrame(rows, "scope string, packet_number long, a double, b double, c int").repartition(5)
    return features, features.groupBy("scope").agg(*moments(NAMES))


def fitted(keyed, limit=None):
    features, scale = keyed
    found = restarts.restarted(features, NAMES, scale, ("scope",), 4, 5, 42, limit=limit)
    return {r["scope"]: (r["means"], r["scales"], r["centres"]) for r in found.collect()}


def test_runs_do_not_multiply_the_packets(keyed, monkeypatch):
    """Few scopes give the centres of the way over tables, without a row per packet and run."""
    wanted = fitted(keyed, limit=0)

    def refuse(*_):
        raise AssertionError("packets are repeated for each run")

    monkeypatch.setattr(restarts, "_measured", refuse)
    monkeypatch.setattr(scoped, "BLOCK", 50)
    found = fitted(keyed)
    assert found.keys() == wanted.keys() == {"s0", "s1", "s2", "few"}
    for key, (means, scales, centres) in wanted.items():
        assert found[key][:2] == (means, scales)
        assert [c is None for c in found[key][2]] == [c is None for c in centres]
        assert np.allclose([c for c in found[key][2] if c], [c for c in centres if c], atol=1e-8)
    assert sum(c is None for c in wanted["few"][2]) == 2


def test_blocks_hold_each_packet_of_a_scope_once(keyed, monkeypatch):
    monkeypatch.setattr(scoped, "BLOCK", 50)
    features, scale = keyed
    held = sorted((r for r in scale.collect() if r["scope"]), key=lambda r: r["scope"])
    stored = scoped.points(features, NAMES, held, ("scope",)).collect()
    found = []
    for block in stored:
        numbers, z = np.frombuffer(block["numbers"], np.int64), np.frombuffer(block["z"]).reshape(3, -1)
        assert 0 < len(numbers) == z.shape[1] <= 50
        row = held[block["scope"]]
        values = z.T * row["scales"] + row["means"]
        found += [(row["scope"], int(n), *(round(x, 6) + 0.0 for x in v)) for n, v in zip(numbers, values.tolist(), strict=True)]
    wanted = features.filter("scope is not null").select("scope", "packet_number", "a", "b", F.col("c").cast("double"))
    assert sorted(found) == sorted(map(tuple, wanted.collect()))


def test_members_are_those_of_all_distances():
    """Ties, centres within rounding of each other, absent ones, far values and values that are no numbers."""
    rng = np.random.default_rng(8)
    z = np.round(rng.normal(size=(3, 500)), 1)
    z[:, 3], z[0, 4], z[:, 5] = np.nan, np.inf, 1e9
    centres = np.round(rng.normal(size=(4, 5, 3)), 1)
    centres[0, 1], centres[1, 2], centres[1, 0], centres[2, 3] = centres[0, 0], ABSENT, centres[1, 1] + 1e-12, centres[2, 4]
    with np.errstate(invalid="ignore"):
        own = scoped.members(z, centres)
        assert (own.sum(axis=1) == 1).all()
        for run, c in enumerate(centres):
            assert (own[run].argmax(axis=0) == scoped.squares(z, c).argmin(axis=0)).all()

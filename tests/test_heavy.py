"""Most frequent values from summaries: the three ways to them, and the bound of the counters."""

import random
from collections import Counter

import pytest

from packetweave.operators import heavy


def plain(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda p: (-p[1], p[0]))[:k]


@pytest.mark.parametrize(("capacity", "most", "way"), [(4096, 100, heavy.COUNTERS), (40, 100, heavy.CANDIDATES), (40, 3, heavy.FULL), (2, 100, heavy.FULL)])
def test_each_way_gives_the_exact_top(spark, capacity, most, way):
    rng = random.Random(7)
    values = [f"h{i}" for i in range(8) for _ in range(900 - 30 * i)] + [f"r{rng.randrange(900)}" for _ in range(3000)] + [None] * 50
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "ip string").repartition(6)
    found = heavy.top_values(df, "ip", 5, capacity, most)
    assert found.way == way
    assert [(r["ip"], r["packets"]) for r in found.rows.orderBy("rank").collect()] == plain(values, 5)


def test_ties_and_few_values(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", "b", None]], "ip string")
    assert [(r["ip"], r["packets"]) for r in heavy.top_values(df, "ip", 2).rows.orderBy("rank").collect()] == [("a", 2), ("b", 2)]
    assert heavy.top_values(df, "ip", 9, capacity=1).rows.count() == 3
    assert heavy.top_values(df.limit(0), "ip", 2).rows.collect() == []


def test_counters_are_too_low_by_at_most_what_was_taken():
    rng = random.Random(1)
    counts, taken, true = {}, 0, Counter()
    for _ in range(200):
        batch = Counter(int(rng.paretovariate(0.6)) for _ in range(50))
        true += batch
        for value, n in batch.items():
            counts[value] = counts.get(value, 0) + n
        counts, more = heavy.reduced(counts, 20)
        taken += more
    assert len(counts) <= 20 and all(0 <= n - counts.get(v, 0) <= taken for v, n in true.items())

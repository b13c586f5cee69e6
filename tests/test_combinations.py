"""Minimal rare sets against every subset of every packet's values."""

import random
from collections import Counter
from itertools import combinations as subsets

from packetweave.operators.combinations import ATTRIBUTES, attributes, rare_combinations

SCHEMA = "frame_number long, timestamp double, src_ip string, dst_ip string, protocol string, length double, info string"


def test_reasons_are_the_minimal_rare_sets(spark):
    rng = random.Random(2)
    rows = [(
        i, 0.0, rng.choice(["10.0.0.1", "8.8.8.8", None]), rng.choice(["10.0.0.2", "9.9.9.9"]), rng.choice(["TCP"] * 30 + ["UDP"] * 8 + [None, f"X{i % 7}"]),
        rng.choice([60.0] * 5 + [500.0, 500.0, 1500.0, None]), rng.choice(["5 → 80"] * 3 + ["x", None])) for i in range(1500)]
    packets = spark.createDataFrame(rows, SCHEMA)
    share = 0.03
    kinds = {r["frame_number"]: [f"{a}={r[f'_{a}']}" for a in ATTRIBUTES] for r in packets.na.fill({"protocol": "unknown", "info": ""}).withColumns(
        {f"_{a}": c for a, c in attributes(packets).items()}).collect()}
    held = {i: [frozenset(c) for n in range(1, 5) for c in subsets(k, n)] for i, k in kinds.items()}
    counts = Counter(s for sets in held.values() for s in sets)
    rare = {s for s, n in counts.items() if n < share * len(rows)}
    minimal = {s for s in rare if not any(t < s for t in rare)}
    place = {a: i for i, a in enumerate(ATTRIBUTES)}
    text = lambda s: ", ".join(sorted(s, key=lambda x: place[x.split("=")[0]]))
    wanted = {i: sorted(text(s) for s in sets if s in minimal) for i, sets in held.items()}
    found = {r["frame_number"]: r["reasons"] for r in rare_combinations(packets, share).collect()}
    assert found == {i: reasons for i, reasons in wanted.items() if reasons}
    assert any(", " in r for reasons in found.values() for r in reasons)
    assert rare_combinations(packets.limit(0), share).collect() == []

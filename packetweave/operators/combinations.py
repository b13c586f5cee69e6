"""Packets with rare combinations of protocol, direction, port text and size class.

A set of attribute values is rare when fewer than ``share`` of the packets hold it, and
minimal when every smaller set of its values is frequent; a packet is rare when it holds
a minimal rare set, and those sets are its reasons.

Protocols are counted first: at most 1 / share of them are frequent, the others are
rare by themselves and stand as one in what follows.  The second scan counts whole
combinations: at most (1 / share + 1) x 4 x 2 x 3 rows, whatever the input.  Sets of each
level are sums over these rows, so no further scan counts them, and the flagged combinations are joined
back to the packets as a broadcast of that bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave import schema as S
from packetweave.functions import predicates as P
from packetweave.functions.numbers import as_double
from packetweave.operators.features import with_defaults
from packetweave.storage import materialize

ATTRIBUTES = ("protocol", "direction", "port", "size")
MASKS = range(1, 1 << len(ATTRIBUTES))


def attributes(packets: DataFrame) -> dict[str, Column]:
    """Attribute values of packets whose missing fields are filled."""
    source, target = P.local_extended(F.col("src_ip")) == 1, P.local_extended(F.col("dst_ip")) == 1
    length = F.coalesce(as_double(F.col("length"), dict(packets.dtypes)["length"]), F.lit(0.0))
    return {
        "protocol": F.col("protocol"),
        "direction": F.when(source & target, "inside").when(source, "outward").when(target, "inward").otherwise("outside"),
        "port": F.when(P.port_info(F.col("info")) == 1, "yes").otherwise("no"),
        "size": F.when(length < S.SMALL_BYTES, "small").when(length < S.LARGE_BYTES, "medium").otherwise("large"),
    }


def _named(mask: int) -> Column:
    """The set of a row's values under a mask, as text."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{a}="), F.col(f"_{a}")) for i, a in enumerate(ATTRIBUTES) if mask >> i & 1))


def _sets(combinations: DataFrame) -> DataFrame:
    """One row per combination and set it holds: the set, and the sets with one value less."""
    listed = []
    for mask in MASKS:
        smaller = [_named(mask & ~(1 << i)) for i in range(len(ATTRIBUTES)) if mask >> i & 1 and mask & ~(1 << i)]
        known = F.col("_protocol").isNotNull() if mask & 1 else F.lit(True)
        listed.append(F.when(known, F.struct(_named(mask).alias("held"), F.array(*smaller).cast("array<string>").alias("smaller"))))
    return combinations.withColumn("_set", F.explode(F.array_compact(F.array(*listed)))).select(
        *(f"_{a}" for a in ATTRIBUTES), "n", F.col("_set.held").alias("held"), F.col("_set.smaller").alias("smaller"))


def minimal_rare_sets(combinations: DataFrame, total: int, share: float) -> DataFrame:
    """(held, packets) of the rare sets all of whose smaller sets are frequent."""
    counts = materialize(_sets(combinations).groupBy("held").agg(F.sum("n").alias("packets"), F.first("smaller").alias("smaller")), "sets")
    frequent = counts.filter(F.col("packets") >= total * share).select(F.col("held").alias("below"))
    rare = counts.filter(F.col("packets") < total * share)
    checked = rare.select("held", "packets", F.explode_outer("smaller").alias("below")).join(
        frequent.withColumn("_frequent", F.lit(True)), "below", "left")
    good = F.bool_and(F.col("below").isNull() | F.coalesce("_frequent", F.lit(False)))
    return checked.groupBy("held", "packets").agg(good.alias("minimal")).filter("minimal").select("held", "packets")


def rare_combinations(packets: DataFrame, share: float = S.RARE_PROTOCOL_SHARE) -> DataFrame:
    """The rare packets: their columns and ``reasons``, the minimal rare sets they hold, sorted."""
    filled = with_defaults(packets)
    own = filled.withColumns({f"_{a}": c for a, c in attributes(filled).items()})
    protocols = materialize(own.groupBy("_protocol").agg(F.count(F.lit(1)).alias("n")), "protocol-counts")
    total = protocols.agg(F.sum("n")).first()[0] or 0
    # At most 1 / share names.
    frequent = [r["_protocol"] for r in protocols.filter(F.col("n") >= total * share).collect()]
    whole = own.withColumn("_protocol", F.when(F.col("_protocol").isin(frequent), F.col("_protocol")))
    names = [f"_{a}" for a in ATTRIBUTES]
    combinations = materialize(whole.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "combinations")
    rare = minimal_rare_sets(combinations, total, share).select("held")
    flagged = _sets(combinations).join(rare, "held").groupBy(*names).agg(F.sort_array(F.collect_list("held")).alias("_held"))
    flagged = materialize(flagged.withColumnsRenamed({n: f"c{n}" for n in names}), "rare-combinations")
    same = [whole[n].eqNullSafe(flagged[f"c{n}"]) for n in names]
    alone = F.when(F.col("_protocol").isNull(), F.array(F.concat(F.lit("protocol="), F.col("protocol")))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(alone, F.coalesce("_held", F.array().cast("array<string>")))
    joined = whole.join(F.broadcast(flagged), same, "left").withColumn("reasons", F.sort_array(reasons))
    return joined.filter(F.size("reasons") > 0).select(*packets.columns, "reasons")

"""The two feature profiles as projections around one sequence step."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave import schema as S
from packetweave.functions import predicates as P
from packetweave.functions.numbers import as_double
from packetweave.operators import ranking
from packetweave.operators.sequence import BUCKET_FRAMES, delta, with_sequence
from packetweave.storage import attach, freeze, materialize


@dataclass(frozen=True)
class Profile:
    """A named feature set; ``ranked`` profiles need scope facts first."""

    name: str
    features: tuple[str, ...]
    ranked: bool


EXTENDED = Profile("extended", tuple(S.EXTENDED_FEATURES), True)
BASIC = Profile("basic", tuple(S.BASIC_FEATURES), False)


def with_defaults(packets: DataFrame) -> DataFrame:
    """Fill missing addresses, protocol and text with their defaults."""
    present = {c: v for c, v in S.FILL_DEFAULTS.items() if c in packets.columns}
    return packets.na.fill(present)


def _number(df: DataFrame, name: str) -> Column:
    return as_double(F.col(name), dict(df.dtypes)[name])


def scope_facts(packets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per scope: packet count, time range, protocol ranks, common protocols.

    A single scan with map-side combining gives counts and time range per
    protocol; everything else is computed from that small table.
    """
    return facts_of(materialize(protocol_counts(packets, by), "protocols"), by)


def protocol_counts(packets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Packets and time range per protocol; such rows of different packets add up (``merged_counts``)."""
    filled = with_defaults(packets)
    clock = F.coalesce(_number(filled, "timestamp"), F.lit(0.0))
    return filled.groupBy(*by, "protocol").agg(F.count(F.lit(1)).alias("packets"), F.min(clock).alias("t_min"), F.max(clock).alias("t_max"))


def merged_counts(one: DataFrame, other: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return one.unionByName(other).groupBy(*by, "protocol").agg(
        F.sum("packets").alias("packets"), F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"))


def facts_of(per_protocol: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Scope rows from a written table of protocol counts."""
    totals = per_protocol.groupBy(*by).agg(
        F.sum("packets").alias("total"), F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max")
    )
    ranks = (
        ranking.top_n(
            per_protocol.select(*by, "protocol", "packets"),
            by, ranking.most_frequent_first("protocol"), S.RANKED_PROTOCOLS,
        )
        .groupBy(*by)
        .agg(F.map_from_entries(F.collect_list(F.struct("protocol", (F.col("rank") - 1).alias("r")))).alias("ranks"))
    )
    # At most 1 / share protocols can reach the share, so the array is bounded.
    common = (
        attach(per_protocol, freeze(totals, by, "totals"), by, spread="protocol")
        .filter(F.col("packets") >= F.col("total") * S.RARE_PROTOCOL_SHARE)
        .groupBy(*by)
        .agg(F.collect_list("protocol").alias("common"))
    )
    if by:
        rows = totals.join(ranks, list(by), "left").join(common, list(by), "left")
    else:
        rows = totals.crossJoin(F.broadcast(ranks)).crossJoin(F.broadcast(common))
    return freeze(rows, by, "scope")


def _extended(packets: DataFrame, keep: list[str]) -> tuple[DataFrame, Column]:
    filled = with_defaults(packets)
    length = F.coalesce(_number(filled, "length"), F.lit(0.0))
    clock = F.coalesce(_number(filled, "timestamp"), F.lit(0.0))
    info, protocol = F.col("info"), F.col("protocol")
    flat = filled.select(
        *keep,
        length.alias("_length"),
        clock.alias("_clock"),
        protocol.alias("_protocol"),
        P.local_extended(F.col("src_ip")).alias("src_local"),
        P.local_extended(F.col("dst_ip")).alias("dst_local"),
        P.port_info(info).alias("has_port_info"),
        P.error_extended(info).alias("has_error"),
        P.protocol_is(protocol, "TCP").alias("is_tcp"),
        P.protocol_is(protocol, "UDP").alias("is_udp"),
        P.http(protocol).alias("is_http"),
        P.protocol_is(protocol, "DNS").alias("is_dns"),
        *[c.alias(n) for n, c in P.size_flags(length).items()],
    )
    return flat, F.col("_clock")


def _basic(packets: DataFrame, keep: list[str]) -> tuple[DataFrame, Column]:
    info = F.col("info")
    flat = packets.select(
        *keep,
        _number(packets, "length").alias("_length"),
        _number(packets, "timestamp").alias("_clock"),
        P.local_basic(F.col("src_ip")).alias("src_local"),
        P.local_basic(F.col("dst_ip")).alias("dst_local"),
        P.protocol_number(F.col("protocol")).alias("protocol_num"),
        P.error_basic(info).alias("has_error"),
        P.syn(info).alias("is_syn"),
        P.fin(info).alias("is_fin"),
        P.dns_text(info).alias("is_dns"),
    )
    return flat, F.col("_clock")


def rank_of(protocol: Column, ranks: Column) -> Column:
    return F.coalesce(F.try_element_at(ranks, protocol), F.lit(S.UNRANKED)).cast("int")


def normalized(clock: Column, t_min: Column, t_max: Column) -> Column:
    """Position in the time range; a range under one second divides by one."""
    return (clock - t_min) / F.greatest(t_max - t_min, F.lit(1.0))


def feature_frame(
    packets: DataFrame,
    profile: Profile,
    facts: DataFrame | None = None,
    by: tuple[str, ...] = (),
    keep: tuple[str, ...] = (),
    extra: Mapping[str, Column | str] | None = None,
    bucket_frames: int = BUCKET_FRAMES,
    seed: DataFrame | None = None,
    forward_only: bool = False,
) -> DataFrame:
    """Keys, ``frame_number``, ``packet_number``, kept columns and the features.

    Row-local features come first, so the one shuffle of the sequence step
    carries flags and kept columns rather than raw text.  ``extra`` adds user
    features as expressions over the canonical packet columns.  The name
    ``packet_length`` in ``keep`` stands for the parsed length, nulls included.
    ``seed`` continues the sequence of earlier packets; ``forward_only`` turns
    the negative deltas of late packets into 0.  Captures that are no keys are
    still kept apart: packets are ordered by capture and frame number, and the first of each
    capture has delta 0.
    """
    extra = {n: F.expr(c) if isinstance(c, str) else c for n, c in (extra or {}).items()}
    if "packet_length" in keep:
        packets = packets.withColumn("packet_length", _number(packets, "length"))
    within = (S.CAPTURE,) if S.CAPTURE in packets.columns and S.CAPTURE not in by and seed is None else ()
    carried = list(dict.fromkeys([*by, *within, "frame_number", *keep]))
    staged = packets.withColumns({f"_extra_{n}": c for n, c in extra.items()}) if extra else packets
    build = _extended if profile.ranked else _basic
    flat, clock = build(staged, carried + [f"_extra_{n}" for n in extra])
    ordered = with_sequence(flat, clock, by, bucket_frames=bucket_frames, seed=seed, within=within)

    step = delta(clock)
    made = {"time_delta": F.greatest(step, F.lit(0.0)) if forward_only else step}
    if profile.ranked:
        if facts is None:
            raise ValueError("the extended profile needs scope facts")
        ordered = attach(ordered, facts.select(*by, "ranks", "t_min", "t_max"), by)
        made["length"] = F.col("_length")
        made["protocol_encoded"] = rank_of(F.col("_protocol"), F.col("ranks"))
        made["time_normalized"] = normalized(clock, F.col("t_min"), F.col("t_max"))
    else:
        made["Length"] = F.coalesce("_length", F.lit(0.0))
    columns = [made.get(n, F.col(n)).alias(n) for n in profile.features]
    columns += [F.coalesce(F.col(f"_extra_{n}").cast("double"), F.lit(0.0)).alias(n) for n in extra]
    return ordered.select(*[c for c in carried if c not in within or c in keep], "packet_number", *columns)

"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get targets in words.  Equal blocks of words are seats: they are given
to sources by highest quotients target / (2k + 1), then within a source to
groups of shards and to shards the same way, so every shard has an integer
quota.  In a shard, documents lie in seeded order on one line of blocks, and a
seeded systematic draw takes the quota: block i is taken floor(((i+1)q + r)/n) -
floor((iq + r)/n) times, r seeded.  So the words taken from a document follow
from its place on the line, without a row per block.  DataFrame functions only.

Null texts have size 0, null sources are one source, null ids are told apart by
their texts.  Repeated rows are documents of their own; which of two
equal rows comes first makes no difference to the result as a set.  An empty table gives an
empty plan.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetweave.storage import materialize

# Fixed values of the mix.
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SEED = 42
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 18
SHARDS_PER_GROUP = 1024


def seeded(*parts: Column) -> Column:
    """A seeded integer of 60 bits that any engine with MD5 can repeat."""
    text = F.concat_ws(":", F.lit(str(SEED)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def document_sizes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"), "source", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        seeded(F.col(key), F.md5(text)).alias("draw"))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``place`` and ``target`` to one row (source, source_size) per source.

    Targets share ``SHARE`` of all sizes by weight and stop at ``MOST`` times the
    size.  The level that reshared excess leads to is found in one pass: sorted by
    cap per weight, those below the level are a prefix.  Windows without keys: one
    row per source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") - 1) % len(weights) + 1)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    rows = (
        sources.withColumn("place", place).withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(MOST))
        .withColumn("total", F.sum("source_size").over(everything) * SHARE)
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("order", F.row_number().over(by_cap))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    )
    level = F.min_by("level", F.when(F.col("fits"), F.col("order"))).over(everything)
    return rows.withColumn("target", F.least("cap", level * F.col("weight"))).select("source", "source_size", "place", "target")


def apportion(rows: DataFrame, by: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Adds integer ``quota``: the seats of each group, by Sainte-Laguë.

    A divisor that surely gives too few seats settles all but a few per row;
    only quotients that can win the rest are listed, a bounded number per row on
    average, and ranked.  Ties go to the smaller key.
    """
    group = Window.partitionBy(*by)
    sums = (
        rows.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_w", F.sum(weight).over(group))
        .withColumn("_share", F.when(F.col("_w") > 0, F.col(weight) / F.col("_w")).otherwise(0.0))
        .withColumn("_base", F.floor(F.greatest(F.col(seats) - F.col("_n"), F.lit(0)) * F.col("_share") + 0.5))
        .withColumn("_base", F.when((F.col(seats) > F.col("_n")) & (F.col("_w") > 0), F.col("_base")).otherwise(F.lit(0)).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_base").over(group))
    )
    extra = F.sequence(F.lit(0), F.ceil(1.5 * F.col("_n") * F.col("_share")).cast("int") + 1)
    ranked = sums.withColumn("_j", F.explode(extra)).withColumn("_q", F.col(weight) / (2 * (F.col("_base") + F.col("_j")) + 1))
    rank = F.row_number().over(group.orderBy(F.col("_q").desc(), key, "_j"))
    won = ranked.withColumn("_rank", rank).withColumn("_won", (F.col("_rank") <= F.col("_left")) & (F.col("_w") > 0))
    return won.groupBy(*rows.columns).agg((F.first("_base") + F.count_if("_won")).alias("quota"))


def shard_quotas(shards: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Seats of sources, then of their groups of shards, then of shards."""
    whole = targets.withColumn("_all", F.lit(0)).withColumn("seats", F.round(
        F.sum("target").over(Window.partitionBy("_all")) / block_words).cast("long"))
    sources = apportion(whole, ["_all"], "place", "target", "seats").select("place", F.col("quota").alias("source_quota"))
    groups = shards.groupBy("place", "shard_group").agg(F.sum("shard_size").alias("group_size"))
    groups = apportion(groups.join(sources, "place"), ["place"], "shard_group", "group_size", "source_quota")
    parts = shards.join(groups.select("place", "shard_group", F.col("quota").alias("group_quota")), ["place", "shard_group"])
    return apportion(parts, ["place", "shard_group"], "shard", "shard_size", "group_quota").select("place", "shard", "shard_size", "quota")


def taken_before(at: Column, quota: Column, blocks: Column, start: Column, block_words: int) -> Column:
    """Words taken from the first ``at`` words of a shard."""
    block = F.floor(at / block_words)
    times = lambda i: F.floor((i * quota + start) / blocks)
    return times(block) * block_words + (times(block + 1) - times(block)) * (at - block * block_words)


def plan_mix(
    docs: DataFrame, key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Words that the mix takes from each document.

    Returns doc_id, source, size, source_size, target, shard, shard_start (first
    word's place on the shard's line), quota, taken.
    """
    sizes = materialize(document_sizes(docs, key), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, written so that both joins below see the same rows.
    targets = materialize(source_targets(sources, weights), "mix-targets")
    count = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    placed = (
        sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
        .withColumn("shard", F.col("draw") % count)
        .withColumn("shard_group", F.floor(F.col("shard") / SHARDS_PER_GROUP))
    )
    shards = placed.groupBy("place", "shard_group", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = shard_quotas(shards, targets, block_words)
    line = Window.partitionBy("place", "shard").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("shard_start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    blocks = F.greatest(F.ceil(F.col("shard_size") / block_words), F.lit(1))
    drawn = (
        placed.join(quotas, ["place", "shard"]).withColumn("blocks", blocks)
        .withColumn("quota", F.least("quota", F.col("blocks") * MOST))
        .withColumn("start", seeded(F.col("place"), F.col("shard")) % F.col("blocks"))
    )
    taken = lambda at: taken_before(at, F.col("quota"), F.col("blocks"), F.col("start"), block_words)
    words = taken(F.col("shard_start") + F.col("size")) - taken(F.col("shard_start"))
    return drawn.select("doc_id", "source", "size", "source_size", "target", "shard", "shard_start", "quota", words.cast("long").alias("taken"))

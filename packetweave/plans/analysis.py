"""Fit, score and summarise: features, scaling, clustering, anomaly flags.

All fitted values of a scope (the whole input, or one capture when keyed) sit
in one bounded row.  Scoring attaches that row to each packet, so labels,
scores and flags are columns of the packet and no positional join exists.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetweave import schema as S
from packetweave.operators import blocks, bounded, kmeans, kmeans_ml, restarts
from packetweave.operators.features import BASIC, EXTENDED, Profile, feature_frame, scope_facts
from packetweave.operators.quantile import quantile_rows
from packetweave.operators.sequence import BUCKET_FRAMES, bucket_for
from packetweave.operators.scaling import Terms, moments, with_z, z_names
from packetweave.storage import attach, freeze, is_small, materialize

RESTARTS, LLOYD, ML, OVERSAMPLED = "restarts", "lloyd", "ml", "oversampled"
# Above so many centre coordinates the distances no longer fit into one compiled method.
MOST_TERMS = 100


class AnalysisError(ValueError):
    """The input cannot be analysed: empty, too few packets or a bad setting."""


@dataclass(frozen=True)
class Settings:
    profile: Profile = EXTENDED
    by: tuple[str, ...] = ()
    k: int = S.DEFAULT_CLUSTERS
    percentile: float = S.DEFAULT_PERCENTILE
    trainer: str = RESTARTS
    # Of the Lloyd trainer only; the others run to convergence.
    iterations: int = 10
    restarts: int = S.DEFAULT_RESTARTS
    seed: int = S.DEFAULT_SEED
    keep: tuple[str, ...] = ()
    k_range: tuple[int, int] | None = None
    minimum_packets: int | None = None

    def check(self) -> None:
        if self.k < 1:
            raise AnalysisError(f"k must be positive, not {self.k}")
        if self.k_range and not self.k_range[0] <= self.k <= self.k_range[1]:
            raise AnalysisError(f"k must lie in {self.k_range[0]}..{self.k_range[1]}, not {self.k}")
        if not 0 <= self.percentile <= 100:
            raise AnalysisError(f"percentile must lie in 0..100, not {self.percentile}")
        if self.trainer not in (RESTARTS, LLOYD, ML, OVERSAMPLED):
            raise AnalysisError(f"unknown trainer {self.trainer}")
        if self.restarts < 1:
            raise AnalysisError(f"restarts must be positive, not {self.restarts}")
        if self.trainer in (ML, OVERSAMPLED) and self.by:
            raise AnalysisError(f"the {self.trainer} trainer fits one model; use another trainer per capture")


def needed_packets(settings: Settings) -> int:
    return max(settings.k, settings.minimum_packets or 0)


def check_counts(facts: DataFrame, settings: Settings) -> DataFrame:
    """The scopes with too few packets; refuses input in which no scope has enough."""
    needed = needed_packets(settings)
    short = facts.filter(F.coalesce("total", F.lit(0)) < needed)
    if facts.filter(F.col("total") >= needed).isEmpty():
        most = facts.agg(F.max("total")).first()[0] or 0
        raise AnalysisError(f"not enough packets ({most}): {needed} needed")
    return short.select(*settings.by, F.col("total").alias("packets"), F.lit(needed).alias("needed"))


@dataclass(frozen=True)
class Analysis:
    """A fitted analysis.

    ``model`` has one row per scope.  ``packets`` is the stored table of the
    packets it was fitted on: keys, kept columns, features, ``cluster_id`` and
    ``distance``.  ``rejected`` has the scopes with too few packets (keys,
    packets, needed); they have no model and the others are not affected.
    ``extra`` holds the user features; those given as SQL text are stored with the model.
    """

    settings: Settings
    feature_names: tuple[str, ...]
    model: DataFrame
    packets: DataFrame | None = None
    rejected: DataFrame | None = None
    extra: Mapping[str, Column | str] = field(default_factory=dict)

    @property
    def by(self) -> tuple[str, ...]:
        return self.settings.by

    def scaled(self, keep: tuple[str, ...] = ()) -> DataFrame:
        """Standardised columns ``z1..zd`` of the fitted packets."""
        terms = Terms.of(self.model, self.by, len(self.feature_names))
        return with_z(terms.place(self.packets), self.feature_names, terms, _kept(self.by, keep))

    def assign(self, features: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``cluster_id`` and ``distance`` for any feature frame."""
        kept = _kept(self.by, keep)
        if _in_blocks(self.settings, self.feature_names):
            row = self.model.first()
            needed = features.select(*dict.fromkeys([*kept, *self.feature_names]))
            return bounded.labelled(needed, self.feature_names, row["means"], row["scales"], row["centres"]).select(*kept, "cluster_id", "distance")
        terms = Terms.of(self.model, self.by, len(self.feature_names), self.settings.k)
        scaled = with_z(terms.place(features), self.feature_names, terms, [*kept, *terms.columns()])
        return kmeans.nearest(scaled, terms, kept)

    def scored(self, features: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Packets with ``cluster_id, distance, anomaly_score, is_anomaly``.

        The fitted packets by default; any other feature frame is assigned first.
        """
        near = self.packets if features is None else self.assign(features, keep)
        near = near.select(*_kept(self.by, keep), "cluster_id", "distance")
        placed = attach(near, self.model.select(*self.by, "score_min", "score_max", "cut"), self.by)
        return placed.select(
            *near.columns,
            min_max(F.col("distance"), F.col("score_min"), F.col("score_max")).alias("anomaly_score"),
            (F.col("distance") > F.col("cut")).alias("is_anomaly"),
        )

    def distances(self) -> DataFrame:
        """Distance of every packet to every centre, plus the nearest one."""
        if _in_blocks(self.settings, self.feature_names):
            row = self.model.first()
            found = bounded.labelled(self.packets, self.feature_names, row["means"], row["scales"], row["centres"], distances=True)
            return found.select(*_kept(self.by, ()), "cluster_id", "distance", *[F.col("distances")[i].alias(f"distance_{i}") for i in range(self.settings.k)])
        each = [F.sqrt(F.col(f"_d{i}")).alias(f"distance_{i}") for i in range(self.settings.k)]
        return self.assign(self.packets).select(*_kept(self.by, ()), "cluster_id", "distance", *each)

    def centres(self) -> DataFrame:
        """``(cluster_id, feature, centre)`` in standardised space."""
        rows = self.model.select(*self.by, F.posexplode("centres").alias("cluster_id", "centre"))
        names = F.array(*[F.lit(n) for n in self.feature_names])
        return rows.filter(F.col("centre").isNotNull()).select(
            *self.by, "cluster_id", F.posexplode(F.arrays_zip(names.alias("feature"), F.col("centre").alias("centre"))).alias("_at", "_pair")
        ).select(*self.by, "cluster_id", F.col("_pair.feature").alias("feature"), F.col("_pair.centre").alias("centre"))

    def summary(self) -> DataFrame:
        """One row per scope with the nested summary document."""
        sizes = F.filter(self._sizes(), lambda p: p["packets"] > 0)
        small = F.filter(sizes, lambda p: p["packets"] < F.col("total") * S.SMALL_CLUSTER_SHARE)
        return self.model.select(
            *self.by,
            F.col("total").alias("total_packets"),
            F.lit(self.settings.k).alias("num_clusters"),
            F.size(sizes).alias("cluster_count"),
            F.map_from_entries(F.transform(sizes, lambda p: F.struct(p["name"], p["packets"]))).alias("cluster_sizes"),
            F.struct(
                F.col("mean_score"), F.col("std_score"),
                F.col("threshold").alias("high_anomaly_threshold"),
                F.col("above").alias("high_anomaly_count"),
            ).alias("anomaly_statistics"),
            F.transform(small, lambda p: p["name"]).alias("small_clusters"),
        )

    def _sizes(self) -> Column:
        return F.transform(
            "sizes",
            lambda n, i: F.struct(F.concat(F.lit("cluster_"), i.cast("string")).alias("name"), n.alias("packets")),
        )

    def cluster_sizes(self) -> DataFrame:
        """``cluster_id, packets, total, percent, is_small`` of found clusters."""
        rows = self.model.select(*self.by, "total", F.posexplode("sizes").alias("cluster_id", "packets"))
        return rows.filter("packets > 0").select(
            *self.by, "cluster_id", "packets", "total",
            (F.col("packets") * 100.0 / F.col("total")).alias("percent"),
            (F.col("packets") < F.col("total") * S.SMALL_CLUSTER_SHARE).alias("is_small"),
        )

    def save(self, path: str) -> None:
        """Store the scope rows; settings that scoring needs travel as columns."""
        texts = {n: c for n, c in self.extra.items() if isinstance(c, str)}
        if len(texts) < len(self.extra):
            raise AnalysisError("user features are stored as SQL text; give them to fit as text")
        self.model.select(
            "*",
            F.lit(self.settings.profile.name).alias("_profile"),
            F.lit(self.settings.k).alias("_k"),
            F.array(*[F.lit(c) for c in self.by]).cast("array<string>").alias("_by"),
            F.array(*[F.lit(n) for n in self.feature_names]).alias("_features"),
            F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]).cast("map<string,string>").alias("_extra"),
        ).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Analysis:
    """Read a stored analysis for scoring new packets."""
    stored = spark.read.parquet(path)
    head = stored.first()
    profile = {p.name: p for p in (EXTENDED, BASIC)}[head["_profile"]]
    settings = Settings(profile=profile, by=tuple(head["_by"]), k=head["_k"])
    model = stored.drop("_profile", "_k", "_by", "_features", "_extra")
    return Analysis(settings, tuple(head["_features"]), model, extra=dict(head["_extra"]))


def _in_blocks(settings: Settings, names: tuple[str, ...]) -> bool:
    """One model with many centre coordinates: distances go over blocks of rows."""
    return not settings.by and settings.k * len(names) > MOST_TERMS


def _kept(by: tuple[str, ...], keep: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys([*by, "frame_number", "packet_number", *keep]))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """0..1 scaling; when all scores are equal they stay as they are."""
    return F.when(high > low, (score - low) / (high - low)).otherwise(score)


def _training_rows(stored: DataFrame, facts: DataFrame, names: tuple[str, ...], settings: Settings) -> DataFrame:
    """Scaler and start centres of every scope.

    The start rows are a selective scan; only k rows per scope pass it.
    """
    by, k = settings.by, settings.k
    scale = stored.groupBy(*by).agg(*moments(names))
    raw = F.array(*[F.col(n).cast("double") for n in names])
    if not by:
        total = facts.first()["total"]
        positions = [kmeans.start_position(total, k, i) for i in range(k)]
        found = {
            r["packet_number"]: r["raw"]
            for r in stored.filter(F.col("packet_number").isin(positions)).select("packet_number", raw.alias("raw")).collect()
        }
        row = scale.first()
        centres = [
            [round((x - m) / s, kmeans.CENTRE_PLACES) for x, m, s in zip(found[p], row["means"], row["scales"])]
            for p in positions
        ]
        return stored.sparkSession.createDataFrame([(row["means"], row["scales"], centres)], kmeans.TRAINED)
    wanted = F.array(*[F.floor(F.lit(i + 0.5) * F.col("total") / F.lit(k)) + 1 for i in range(k)])
    starts = (
        attach(stored, facts.select(*by, wanted.alias("_wanted")), by)
        .filter(F.array_contains("_wanted", F.col("packet_number")))
        .select(*by, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i"), "_wanted", "packet_number", raw.alias("_raw"))
        .filter(F.col("_wanted")[F.col("_i")] == F.col("packet_number"))
        .groupBy(*by)
        .agg(F.map_from_entries(F.collect_list(F.struct("_i", "_raw"))).alias("_starts"))
    )
    centre = "zip_with(zip_with(_starts[i], means, (x, m) -> x - m), scales, (x, s) -> round(x / s, {}))"
    rows = scale.join(starts, list(by), "left").select(
        *by, "means", "scales",
        F.expr(f"transform(sequence(0, {k - 1}), i -> {centre.format(kmeans.CENTRE_PLACES)})").alias("centres"),
    )
    return freeze(rows, by, "training")


def _ml_rows(stored: DataFrame, training: DataFrame, names: tuple[str, ...], settings: Settings) -> DataFrame:
    z = z_names(len(names))
    scaled = with_z(stored, names, Terms.of(training, (), len(names)), [])
    centres, _ = kmeans_ml.best_centres(scaled, z, settings.k, settings.restarts, settings.seed)
    arrays = [F.array(*[F.lit(x) for x in c]) for c in centres]
    arrays += [F.lit(None).cast("array<double>")] * (settings.k - len(centres))
    return freeze(training.select("means", "scales", F.array(*arrays).alias("centres")), (), "centres")


def _label(stored: DataFrame, trained: DataFrame, names: tuple[str, ...], settings: Settings) -> DataFrame:
    """Write the packets once more with label and distance.

    Every later pass reads a few columns of this table instead of repeating
    the distance arithmetic.
    """
    by = settings.by
    if _in_blocks(settings, names):
        row = trained.first()
        return materialize(bounded.labelled(stored, names, row["means"], row["scales"], row["centres"]), "packets")
    if not by or is_small(trained):
        return materialize(blocks.labelled(stored, names, trained.collect(), by, settings.k), "packets")
    terms = Terms.of(trained, by, len(names), settings.k)
    kept = [f"`{c}`" for c in stored.columns]
    scaled = with_z(terms.place(stored), names, terms, [*kept, *terms.columns()])
    near = kmeans.nearest(scaled, terms, kept)
    return materialize(near.select(*kept, "cluster_id", "distance"), "packets")


def _score_rows(near: DataFrame, settings: Settings) -> DataFrame:
    """Cluster sizes, score range and threshold of the labelled packets."""
    by, k = settings.by, settings.k
    sizes = [F.count(F.when(F.col("cluster_id") == i, 1)) for i in range(k)]
    stats = freeze(
        near.groupBy(*by).agg(
            F.array(*sizes).alias("sizes"),
            F.min("distance").alias("score_min"),
            F.max("distance").alias("score_max"),
            F.avg("distance").alias("_mean"),
            F.stddev_pop("distance").alias("_std"),
        ),
        by, "scores",
    )
    cut = quantile_rows(near, "distance", settings.percentile / 100.0, by, name="cut")
    above = (
        attach(near, cut, by)
        .groupBy(*by)
        .agg(F.count(F.when(F.col("distance") > F.col("cut"), 1)).alias("above"))
    )
    if by:
        rows = stats.join(cut, list(by), "left").join(above, list(by), "left")
    else:
        rows = stats.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(above))
    low, high = F.col("score_min"), F.col("score_max")
    width = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return freeze(
        rows.select(
            *by, "sizes", "score_min", "score_max", "cut", "above",
            min_max(F.col("_mean"), low, high).alias("mean_score"),
            (F.col("_std") / width).alias("std_score"),
            min_max(F.col("cut"), low, high).alias("threshold"),
        ),
        by, "scores",
    )


def fit(
    packets: DataFrame, extra: Mapping[str, Column | str] | None = None, **options
) -> Analysis:
    """Cluster ``packets`` (canonical columns) and derive scores and threshold.

    ``options`` are the fields of :class:`Settings`; ``extra`` adds user
    features, standardised and clustered like the others, as SQL text or columns.
    """
    settings = Settings(**options)
    settings.check()
    by = settings.by
    facts = scope_facts(packets, by)
    rejected = check_counts(facts, settings)
    if by and not rejected.isEmpty():
        facts = freeze(facts.filter(F.col("total") >= needed_packets(settings)), by, "scope")
        packets = attach(packets, facts.select(*by, F.lit(True).alias("_fits")), by).filter("_fits").drop("_fits")
    names = settings.profile.features + tuple(extra or {})
    width = BUCKET_FRAMES if by else bucket_for(facts.first()["total"], packets.sparkSession)
    stored = materialize(
        feature_frame(packets, settings.profile, facts, by, settings.keep, extra, width), "features"
    )
    if settings.trainer in (RESTARTS, OVERSAMPLED) and not by:
        row = stored.agg(*moments(names)).first()
        starts = "oversampled" if settings.trainer == OVERSAMPLED else "drawn"
        centres, _ = bounded.trained(
            stored, names, row["means"], row["scales"], facts.first()["total"], settings.k, settings.restarts, settings.seed, starts)
        trained = stored.sparkSession.createDataFrame([(row["means"], row["scales"], centres)], kmeans.TRAINED)
    elif settings.trainer == RESTARTS:
        scale = stored.groupBy(*by).agg(*moments(names))
        trained = restarts.restarted(stored, names, scale, by, settings.k, settings.restarts, settings.seed)
    elif settings.trainer == ML:
        trained = _ml_rows(stored, _training_rows(stored, facts, names, settings), names, settings)
    else:
        trained = _training_rows(stored, facts, names, settings)
        trained = kmeans.lloyd(stored, names, trained, by, settings.k, settings.iterations)
    return finished(stored, facts, trained, names, settings, rejected, extra)


def finished(
    stored: DataFrame, facts: DataFrame, trained: DataFrame, names: tuple[str, ...], settings: Settings,
    rejected: DataFrame | None = None, extra: Mapping[str, Column | str] | None = None,
) -> Analysis:
    """The analysis of stored features with trained centres: labels, scores and threshold."""
    by = settings.by
    labelled = _label(stored, trained, names, settings)
    scores = _score_rows(labelled, settings)
    if by:
        model = facts.join(trained, list(by)).join(scores, list(by))
    else:
        model = facts.crossJoin(F.broadcast(trained)).crossJoin(F.broadcast(scores))
    return Analysis(settings, names, freeze(model, by, "model"), labelled, rejected, dict(extra or {}))

"""Refits whose work follows the batch, not the history.

Every batch adds to state that merges: packets and time range per protocol, counts, means and
squared deviations of the features, and per centre a weight and a place.  Once there is a
model, a batch moves its centres by one weighted step: old weights decay, the batch's
packets count one each.  All history is read again only when the cost of a batch has
drifted from that of the last full fit, and for the first fit.

State is versioned by batch id, so a repeated batch reads what it read before.
Protocol ranks and the time range of a batch's features are those of all packets so far; the
deviations of earlier batches stay as they were taken.  Centres are kept in the units of the features, as means and
scales move on.  The scores of a stepped model (sizes, range, threshold) are those of its batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from packetweave import schema as S
from packetweave.operators import bounded
from packetweave.operators.features import facts_of, feature_frame, merged_counts, protocol_counts
from packetweave.operators.kmeans import CENTRE_PLACES, TRAINED
from packetweave.operators.sequence import bucket_for
from packetweave.plans import analysis as A
from packetweave.storage import materialize

DECAY, DRIFT = 0.9, 1.5
STATE = (
    "packets bigint, last_clock double, last_frame bigint, counted double, means array<double>, squares array<double>, "
    "centres array<array<double>>, weights array<double>, cost double")


@dataclass(frozen=True)
class Moments:
    """Count, means and summed squared deviations; they merge exactly."""

    n: float
    means: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, features: DataFrame, names: tuple[str, ...]) -> Moments:
        row = features.agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col(f"`{c}`").cast("double")) for c in names]).alias("means"),
            F.array(*[F.var_pop(F.col(f"`{c}`").cast("double")) for c in names]).alias("spread")).first()
        return cls(float(row["n"]), np.array(row["means"]), np.array(row["spread"]) * row["n"])

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.means - self.means
        return Moments(n, (self.n * self.means + other.n * other.means) / n, self.squares + other.squares + gap * gap * (self.n * other.n / n))

    def scales(self) -> np.ndarray:
        spread = np.sqrt(self.squares / self.n)
        return np.where(spread == 0, 1.0, spread)


@dataclass
class MergingRefitter:
    """Keeps a model of all packets up to date, batch by batch, under ``folder``.

    ``options`` are those of ``fit`` for a model without keys.  A model is stored whenever another
    ``every`` packets have arrived, from ``minimum`` packets on.
    """

    folder: str
    options: dict = field(default_factory=dict)
    minimum: int = S.STREAM_MINIMUM
    every: int = S.STREAM_REFIT_EVERY
    decay: float = DECAY
    drift: float = DRIFT

    def __post_init__(self) -> None:
        self.settings = A.Settings(**self.options)
        self.settings.check()
        if self.settings.by or self.settings.trainer == A.ML:
            raise A.AnalysisError("refits from merged state are for one model, trained by restarts")

    def _earlier(self, spark: SparkSession, batch_id: int) -> tuple[dict, DataFrame] | None:
        if batch_id == 0:
            return None
        try:
            state = spark.read.schema(STATE).parquet(f"{self.folder}/state/{batch_id - 1}").first()
            return state.asDict(), spark.read.parquet(f"{self.folder}/protocols/{batch_id - 1}")
        except AnalysisException as error:
            raise RuntimeError(f"state of batch {batch_id - 1} is missing in {self.folder}") from error

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        spark, names = batch.sparkSession, self.settings.profile.features
        batch.write.mode("overwrite").parquet(f"{self.folder}/history/batch={batch_id}")
        packets = spark.read.parquet(f"{self.folder}/history/batch={batch_id}")
        earlier = self._earlier(spark, batch_id)
        state = earlier[0] if earlier else dict.fromkeys(("last_clock", "last_frame", "centres", "weights", "cost")) | {"packets": 0, "counted": 0.0}
        arrived = packets.count()
        if not arrived:
            self._keep(spark, batch_id, state, earlier[1] if earlier else protocol_counts(packets))
            return
        own = protocol_counts(packets)
        counts = self._keep_counts(merged_counts(earlier[1], own) if earlier else own, batch_id)
        facts = facts_of(counts)
        seed = spark.createDataFrame([(state["packets"], state["last_clock"])], "seed_rows bigint, seed_value double")
        stored = materialize(feature_frame(
            packets, self.settings.profile, facts, (), self.settings.keep, None, bucket_for(arrived, spark), seed=seed), "refit-features")
        clock = F.coalesce(F.col("timestamp").cast("double"), F.lit(0.0))
        last = packets.agg(F.max_by(clock, "frame_number").alias("clock"), F.max("frame_number").alias("frame")).first()
        if state["last_frame"] is None or (last["frame"] or 0) >= state["last_frame"]:
            state |= {"last_clock": last["clock"], "last_frame": last["frame"]}
        moments = Moments.of(stored, names)
        if state["counted"]:
            moments = Moments(state["counted"], np.array(state["means"]), np.array(state["squares"])).merged(moments)
        before, state["packets"] = state["packets"], state["packets"] + arrived
        if state["packets"] < max(self.minimum, self.settings.k):
            self._keep(spark, batch_id, self._with(state, moments))
            return
        kind, read = "step", arrived
        if state["centres"] is None:
            kind = "full"
        else:
            stepped, cost = self._step(stored, state, moments)
            kind = "full" if cost > self.drift * state["cost"] else kind
        if kind == "full":
            model, state, read = self._full(spark, batch_id, state)
        else:
            state = self._with(state, moments) | stepped
            if before // self.every < state["packets"] // self.every:
                model = self._model(stored, facts, moments, state, arrived)
            else:
                model = None
        self._keep(spark, batch_id, state)
        if model is not None:
            model.save(f"{self.folder}/models/{batch_id}")
            entry = [(batch_id, state["packets"], kind, read)]
            spark.createDataFrame(entry, "batch_id bigint, packets_so_far bigint, kind string, packets_read bigint").write.mode("overwrite").parquet(f"{self.folder}/fits/batch={batch_id}")

    def _with(self, state: dict, moments: Moments) -> dict:
        return state | {"counted": moments.n, "means": moments.means.tolist(), "squares": moments.squares.tolist()}

    def _keep_counts(self, counts: DataFrame, batch_id: int) -> DataFrame:
        path = f"{self.folder}/protocols/{batch_id}"
        counts.write.mode("overwrite").parquet(path)
        return counts.sparkSession.read.parquet(path)

    def _keep(self, spark: SparkSession, batch_id: int, state: dict, counts: DataFrame | None = None) -> None:
        if counts is not None:
            self._keep_counts(counts, batch_id)
        names = [part.split()[0] for part in STATE.split(", ")]
        spark.createDataFrame([tuple(state.get(n) for n in names)], STATE).write.mode("overwrite").parquet(f"{self.folder}/state/{batch_id}")

    def _step(self, stored: DataFrame, state: dict, moments: Moments) -> tuple[dict, float]:
        """Centres and weights after this batch, and the batch's cost per packet before the step."""
        means, scales = moments.means, moments.scales()
        rows = bounded.points(stored, self.settings.profile.features, means.tolist(), scales.tolist())
        centres = (_array(state["centres"]) - means) / scales
        told = bounded.Told()
        found = bounded._sums(rows, [0], centres[None], None, told)
        cost = bounded.potentials(rows, centres[None], told)[0] / sum(n for n, _ in found.values())
        weights = [w * self.decay for w in state["weights"]]
        for (_, i), (n, total) in found.items():
            centres[i] = (weights[i] * centres[i] + total) / (weights[i] + n)
            weights[i] += n
        return {"centres": _lists(centres * scales + means), "weights": weights}, cost

    def _full(self, spark: SparkSession, batch_id: int, state: dict) -> tuple[A.Analysis, dict, int]:
        history = spark.read.parquet(f"{self.folder}/history").filter(F.col("batch") <= batch_id).drop("batch")
        model = A.fit(history, **self.options)
        row = model.model.first()
        moments = Moments.of(model.packets, model.feature_names)
        cost = model.packets.agg(F.avg(F.col("distance") * F.col("distance"))).first()[0]
        centres = _array(row["centres"]) * np.array(row["scales"]) + np.array(row["means"])
        state = self._with(state, moments) | {"centres": _lists(centres), "weights": [float(n) for n in row["sizes"]], "cost": cost}
        return model, state, row["total"]

    def _model(self, stored: DataFrame, facts: DataFrame, moments: Moments, state: dict, arrived: int) -> A.Analysis:
        means, scales = moments.means, moments.scales()
        centres = [[round(x, CENTRE_PLACES) for x in c] if c else None for c in _lists((_array(state["centres"]) - means) / scales)]
        trained = stored.sparkSession.createDataFrame([(means.tolist(), scales.tolist(), centres)], TRAINED)
        facts = facts.withColumn("total", F.lit(arrived).cast("bigint"))
        return A.finished(stored, facts, trained, self.settings.profile.features, self.settings)

    def newest(self, spark: SparkSession) -> A.Analysis | None:
        """The model stored last, if there is one."""
        try:
            latest = self.fits(spark).agg(F.max("batch_id")).first()[0]
        except AnalysisException:
            return None
        return None if latest is None else A.load(spark, f"{self.folder}/models/{latest}")

    def start(self, stream: DataFrame, **trigger):
        writer = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def fits(self, spark: SparkSession) -> DataFrame:
        """(batch_id, packets_so_far, kind, packets_read) of the stored models."""
        return spark.read.parquet(f"{self.folder}/fits").drop("batch")


def _array(centres: list[list[float] | None]) -> np.ndarray:
    width = max(len(c) for c in centres if c)
    return np.array([c or [math.nan] * width for c in centres])


def _lists(centres: np.ndarray) -> list[list[float] | None]:
    return [None if np.isnan(c).any() else [float(x) for x in c] for c in centres]

"""Packets scored as they arrive.

Each micro-batch runs the same distributed feature and scoring plan as a batch
job.  What must outlive a micro-batch (packets so far and last time per scope)
is one row per scope in a table versioned by batch id, so a repeated batch
reads the same state and overwrites its own output.  A capture that dominates
the stream is still spread over frame-number buckets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from packetweave import schema as S
from packetweave.functions.numbers import as_double
from packetweave.operators.features import feature_frame
from packetweave.plans import analysis as A
from packetweave.streaming.lists import ListArrivals
from packetweave.streaming.refit import MergingRefitter


def packet_stream(
    spark: SparkSession, folder: str, captures: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Canonical packets arriving as parquet files, with the fixed schema."""
    fields = ([T.StructField("capture_id", T.StringType())] if captures else []) + S.PACKETS.fields
    reader = spark.readStream.schema(T.StructType(fields))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def running_counts(stream: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Packets per protocol so far; the state holds one row per protocol."""
    return (
        stream.filter(F.col("protocol").isNotNull())
        .groupBy(*by, "protocol")
        .agg(F.count(F.lit(1)).alias("packets"))
    )


@dataclass
class _State:
    """Per-scope progress of a stream, one parquet folder per batch id."""

    folder: str
    by: tuple[str, ...]

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.folder}/{batch_id - 1}") if batch_id > 0 else None
        except AnalysisException as error:
            raise RuntimeError(f"state of batch {batch_id - 1} is missing in {self.folder}") from error

    def advance(self, batch: DataFrame, clock, earlier: DataFrame | None, batch_id: int) -> None:
        here = batch.groupBy(*self.by).agg(
            F.count(F.lit(1)).alias("seed_rows"), F.max_by(clock, F.col("frame_number")).alias("seed_value"),
            F.max("frame_number").alias("seed_frame"),
        )
        if earlier is not None:
            # Rows of both sides add up; the value of the highest frame stays.
            here = earlier.unionByName(here).groupBy(*self.by).agg(
                F.sum("seed_rows").alias("seed_rows"),
                F.max_by("seed_value", "seed_frame").alias("seed_value"),
                F.max("seed_frame").alias("seed_frame"),
            )
        here.write.mode("overwrite").parquet(f"{self.folder}/{batch_id}")


@dataclass
class LiveScorer:
    """Score a packet stream with a frozen analysis into ``folder/scored``.

    ``fallback`` is an analysis without keys; with it, packets of captures that
    the keyed ``analysis`` doesn't know are scored by the pooled model.  The
    column ``model`` tells which was used: ``own``, ``pooled``, or null where
    neither knows the capture.  With a ``refitter`` every batch is scored by the
    newest model that it has stored, and by ``analysis`` before there is one.  With ``lists`` the
    stream is that of files that arrive (``ListArrivals.stream``).
    """

    analysis: A.Analysis
    folder: str
    keep: tuple[str, ...] = ()
    fallback: A.Analysis | None = None
    refitter: Refitter | MergingRefitter | None = None
    lists: ListArrivals | None = None
    _state: _State = field(init=False)

    def __post_init__(self) -> None:
        self._state = _State(f"{self.folder}/progress", self.analysis.by)

    def score(self, batch: DataFrame, batch_id: int, analysis: A.Analysis | None = None) -> DataFrame:
        """Scored packets of one micro-batch; advances the stream's state."""
        model = analysis or self.analysis
        by, profile = model.by, model.settings.profile
        spark = batch.sparkSession
        earlier = self._state.before(spark, batch_id)
        seed = earlier.drop("seed_frame") if earlier is not None else None
        def features_by(own: A.Analysis) -> DataFrame:
            """Features over the stream's scopes, ranked by the scope rows of ``own``."""
            facts = own.model.select(*own.by, "ranks", "t_min", "t_max") if profile.ranked else None
            if facts is not None and not own.by and by:
                facts = batch.select(*by).distinct().crossJoin(F.broadcast(facts))
            return feature_frame(
                batch, profile, facts, by, ("timestamp", *self.keep), own.extra, seed=seed, forward_only=True
            )

        value = as_double(F.col("timestamp"), dict(batch.dtypes)["timestamp"])
        clock = F.coalesce(value, F.lit(0.0)) if profile.ranked else value
        self._state.advance(batch, clock, earlier, batch_id)
        keep = ("time_delta", *self.keep)
        scored = model.scored(features_by(model), keep=keep)
        scored = scored.withColumn("model", F.when(F.col("cluster_id").isNotNull() & F.col("anomaly_score").isNotNull(), F.lit("own")))
        if self.fallback is None or not by:
            return scored
        # One row per scope; Spark checks its size.
        known = model.model.select(*by)
        pooled = self.fallback.scored(features_by(self.fallback), keep=(*by, *keep)).join(known, list(by), "left_anti")
        return scored.join(known, list(by), "left_semi").unionByName(pooled.withColumn("model", F.lit("pooled")))

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        newest = self.refitter.newest(batch.sparkSession) if self.refitter else None
        if self.lists:
            batch = self.lists.packets(batch, batch_id)
            batch = batch if self.analysis.by else batch.drop(S.CAPTURE)
        # The batch feeds the score and the stream's state; its source is read once.
        scored = self.score(A.materialize(batch, "live-batch"), batch_id, newest)
        scored.write.mode("overwrite").parquet(f"{self.folder}/scored/batch={batch_id}")

    def start(self, stream: DataFrame, **trigger):
        """Start the streaming query; pass e.g. ``availableNow=True``."""
        writer = stream.writeStream.foreachBatch(self._write)
        writer = writer.option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/scored").drop("batch")


@dataclass
class Refitter:
    """Refit over all packets so far whenever another ``every`` have arrived.

    Nothing is fitted before ``minimum`` packets exist.  Packets, progress and
    models are kept per batch id under ``folder``.
    """

    folder: str
    options: dict = field(default_factory=dict)
    minimum: int = S.STREAM_MINIMUM
    every: int = S.STREAM_REFIT_EVERY

    def due(self, before: int, after: int) -> bool:
        if after < self.minimum:
            return False
        return before < self.minimum or after // self.every > before // self.every

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.folder}/history/batch={batch_id}")
        history = spark.read.parquet(f"{self.folder}/history").filter(F.col("batch") <= batch_id)
        # Both counts come from parquet footers and partition values.
        counts = history.groupBy((F.col("batch") < batch_id).alias("old")).count().collect()
        found = {r["old"]: r["count"] for r in counts}
        before = found.get(True, 0)
        after = before + found.get(False, 0)
        if self.due(before, after):
            model = A.fit(history.drop("batch"), **self.options)
            model.save(f"{self.folder}/models/{batch_id}")
            entry = model.summary().select(
                *model.by, F.lit(batch_id).alias("batch_id"), F.lit(after).cast("bigint").alias("packets_so_far"),
                "total_packets", "cluster_count",
            )
            entry.write.mode("overwrite").parquet(f"{self.folder}/fits/batch={batch_id}")

    def newest(self, spark: SparkSession) -> A.Analysis | None:
        """The model of the latest refit, if there is one."""
        try:
            latest = self.fits(spark).agg(F.max("batch_id")).first()[0]
        except AnalysisException:
            return None
        return None if latest is None else A.load(spark, f"{self.folder}/models/{latest}")

    def start(self, stream: DataFrame, **trigger):
        writer = stream.writeStream.foreachBatch(self._batch)
        writer = writer.option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def fits(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/fits").drop("batch")

"""Data series behind the charts, as DataFrames ready to plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetweave import schema as S
from packetweave.operators.pca import Components, ScopedComponents, principal_components, scoped_components
from packetweave.operators.sampling import sample_exact
from packetweave.operators.scaling import z_names
from packetweave.plans.analysis import Analysis
from packetweave.storage import attach


def score_histogram(analysis: Analysis, bins: int = S.HISTOGRAM_BINS) -> DataFrame:
    """Equal bins over the score range, last bin closed, empty bins included.

    When all scores are equal the range is widened by one half on each side.
    """
    by = analysis.by
    same = F.col("score_max") <= F.col("score_min")
    ends = analysis.model.select(
        *by,
        F.when(same, F.col("score_min") - 0.5).otherwise(F.lit(0.0)).alias("_low"),
        F.when(same, F.col("score_min") + 0.5).otherwise(F.lit(1.0)).alias("_high"),
        "threshold",
    )
    placed = attach(analysis.scored(), ends, by)
    position = F.floor((F.col("anomaly_score") - F.col("_low")) * bins / (F.col("_high") - F.col("_low")))
    counts = (
        placed.select(*by, F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("packets"))
    )
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_high") - F.col("_low")) / bins
    return grid.join(counts, [*by, "bin"], "left").select(
        *by, "bin",
        (F.col("_low") + F.col("bin") * width).alias("bin_start"),
        (F.col("_low") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("packets", F.lit(0)).alias("packets"),
        "threshold",
    )


def feature_importance(analysis: Analysis) -> DataFrame:
    """Sample variance over clusters of the unscaled feature means; null for one cluster."""
    by, names = analysis.by, analysis.feature_names
    means = analysis.packets.groupBy(*by, "cluster_id").agg(*[F.avg(F.col(n)).alias(n) for n in names])
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("mean")) for n in names])
    return (
        means.select(*by, F.explode(entries).alias("e"))
        .groupBy(*by, F.col("e.feature").alias("feature"))
        .agg(F.var_samp("e.mean").alias("importance"))
    )


def score_timeline(analysis: Analysis) -> DataFrame:
    """Score per packet number with the threshold line and the marked packets."""
    rows = analysis.model.select(*analysis.by, "threshold")
    return attach(analysis.scored(), rows, analysis.by).select(
        *analysis.by, "packet_number", "anomaly_score", "threshold", "is_anomaly"
    )


def length_against_score(analysis: Analysis) -> DataFrame:
    length = analysis.feature_names[0]
    return analysis.scored(keep=(length,)).select(
        *analysis.by, "packet_number", F.col(length).alias("length"), "anomaly_score", "cluster_id"
    )


def components(analysis: Analysis, k: int = 2) -> Components | ScopedComponents:
    """Components of the whole input, or of each capture of a keyed analysis."""
    names = z_names(len(analysis.feature_names))
    if analysis.by:
        return scoped_components(analysis.scaled(), names, analysis.feature_names, analysis.by, k)
    return principal_components(analysis.scaled(), names, analysis.feature_names, k)


def _placed(analysis: Analysis, rows: DataFrame, found: Components | ScopedComponents) -> DataFrame:
    """Rows with the loadings of their scope, where there are several."""
    if not analysis.by:
        return rows
    spread = "packet_number" if "packet_number" in rows.columns else "cluster_id"
    return attach(rows, found.rows.drop("ratios"), analysis.by, spread=spread)


def projection(analysis: Analysis, found: Components | ScopedComponents, budget: int | None = None, seed: int = S.DEFAULT_SEED) -> DataFrame:
    """Packets in component space; with ``budget`` an exact sample of so many, the same however the packets are dealt out."""
    names = z_names(len(analysis.feature_names))
    points = _placed(analysis, analysis.scaled(keep=("cluster_id",)), found).select(
        *analysis.by, "packet_number", "cluster_id", *found.projections(names)
    )
    return points if budget is None else sample_exact(points, budget, [*analysis.by, "packet_number"], seed)


def projected_centres(analysis: Analysis, found: Components | ScopedComponents) -> DataFrame:
    names = z_names(len(analysis.feature_names))
    rows = analysis.model.select(*analysis.by, F.posexplode("centres").alias("cluster_id", "centre"))
    flat = rows.filter(F.col("centre").isNotNull()).select(
        *analysis.by, F.col("cluster_id").cast("int").alias("cluster_id"),
        *[F.col("centre")[i].alias(n) for i, n in enumerate(names)],
    )
    return _placed(analysis, flat, found).select(*analysis.by, "cluster_id", *found.projections(names))


def loadings(analysis: Analysis, found: Components | ScopedComponents, top: int | None = 5) -> DataFrame:
    """``component, rank, feature, weight, ratio``: d x components rows per scope."""
    if isinstance(found, ScopedComponents):
        named = F.array(*[F.lit(n) for n in found.features])
        pairs = F.arrays_zip(named.alias("feature"), F.col("weights").alias("weight"))
        # Largest first; equal weights in feature order.
        order = F.array_sort(F.transform(pairs, lambda p, i: F.struct(
            (-F.abs(p["weight"])).alias("size"), i.alias("place"), p["feature"].alias("feature"), p["weight"].alias("weight"))))
        listed = found.rows.select(*found.by, "ratios", F.posexplode("loadings").alias("at", "weights")).select(
            *found.by, (F.col("at") + 1).cast("int").alias("component"), F.col("ratios")[F.col("at")].alias("ratio"), F.posexplode(order).alias("n", "p"))
        rows = listed.select(*found.by, "component", (F.col("n") + 1).cast("int").alias("rank"), "p.feature", "p.weight", "ratio")
        return rows if top is None else rows.filter(F.col("rank") <= top)
    rows = []
    for number, weights in enumerate(found.loadings, 1):
        ordered = sorted(zip(found.features, weights), key=lambda p: -abs(p[1]))
        rows += [
            (number, place, feature, weight, found.ratios[number - 1])
            for place, (feature, weight) in enumerate(ordered, 1)
            if top is None or place <= top
        ]
    return analysis.model.sparkSession.createDataFrame(
        rows, "component int, rank int, feature string, weight double, ratio double"
    )

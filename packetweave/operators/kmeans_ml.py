"""K-means with Spark ML: several seeded runs, the cheapest one kept."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from packetweave import schema as S


def z_vectors(scaled: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    assembled = VectorAssembler(inputCols=names, outputCol="z").transform(scaled)
    return assembled.select(*keep, "z")


def best_centres(
    scaled: DataFrame,
    names: list[str],
    k: int,
    restarts: int = S.DEFAULT_RESTARTS,
    seed: int = S.DEFAULT_SEED,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> tuple[list[list[float]], float]:
    """Centres (at most ``k``, fewer for few distinct rows) and training cost.

    The trainer keeps the vectors of a run itself, ready with their norms, and drops them after it.  Of a frame that
    is cached already it would decode every row again at each step.
    """
    vectors = z_vectors(scaled, names, [])
    best = None
    for run in range(restarts):
        trainer = KMeans(featuresCol="z", k=k, seed=seed + run, maxIter=max_iter, tol=tol)
        model = trainer.fit(vectors)
        cost = model.summary.trainingCost
        if best is None or cost < best[1]:
            best = ([[float(x) for x in c] for c in model.clusterCenters()], cost)
    return best

"""Times the headline queries and prints one JSON line.

Every query is timed with the fit it needs; ``fits`` lists the fits alone.
"""

from __future__ import annotations

import json
import os
import time

from packetweave import BASIC, EXTENDED, fit
from packetweave.checks import queries as registry
from packetweave.checks.views import spark_packets
from packetweave.plans.analysis import LLOYD, ML, OVERSAMPLED
from packetweave.session import local_session

HEADLINE = [
    "features_ext", "features_basic", "features_ext_by_capture", "traffic_summary", "protocol_distribution",
    "flagged_packets", "zscore", "high_anomalies", "analysis_summary", "score_histogram", "feature_importance",
    "anomaly_reasons", "cluster_top3", "cluster_profile", "anomaly_report", "long_packets", "sample_exact",
    "scan_quoted_csv", "pca_projection", "stream_score", "kmeans_ml", "kmeans_lloyd_by_capture", "kmeans_restarts", "pca_loadings_by_capture",
]
FITS = {
    "extended": {}, "extended_by_capture": {"by": ("capture_id",)}, "extended_ml": {"profile": EXTENDED, "trainer": ML},
    "extended_oversampled": {"trainer": OVERSAMPLED}, "extended_k20": {"k": 20, "restarts": 2}, "extended_lloyd": {"trainer": LLOYD}, "basic_lloyd": {"profile": BASIC, "trainer": LLOYD},
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.registered()
    # Starts the executors' threads and compiles the common paths.
    known["flagged_packets"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds, fits = {}, {}
    for name, options in FITS.items():
        begun = time.perf_counter()
        fit(spark_packets(spark, folder, "by" in options), **options)
        fits[name] = round(time.perf_counter() - begun, 3)
    for name in HEADLINE:
        registry.forget_fits()
        begun = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "fits": fits, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "packets": spark.read.parquet(f"{folder}/events.parquet").count(),
    }))


if __name__ == "__main__":
    main()

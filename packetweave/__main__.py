"""Command line: ``python -m packetweave extended|basic <packet list> ...``.

Submit with ``spark-submit`` on a cluster; without a running session the usual
Spark configuration applies.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetweave import schema as S
from packetweave.operators.features import BASIC, EXTENDED
from packetweave.operators.sampling import sample_exact
from packetweave.plans import anomalies, clusters, series, traffic
from packetweave.plans.analysis import LLOYD, ML, OVERSAMPLED, RESTARTS, Analysis, AnalysisError, fit
from packetweave.sources import sinks
from packetweave.sources.packets import PacketLists, SourceError, read_lists
from packetweave.storage import materialize


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="packetweave", description="Cluster packet lists and report anomalies")
    commands = parser.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    # Names of the options.
    shared.add_argument("--clusters", "-c", type=int, default=S.DEFAULT_CLUSTERS)
    shared.add_argument("--threshold", type=float, default=S.DEFAULT_PERCENTILE, help="anomaly percentile")
    shared.add_argument("--trainer", choices=[RESTARTS, OVERSAMPLED, ML, LLOYD], default=RESTARTS)
    shared.add_argument("--mode", choices=["auto", "strict", "tolerant"], default="auto")

    extended = commands.add_parser("extended", parents=[shared], help="15 features, scores and summary")
    extended.add_argument("paths", nargs="+")
    extended.add_argument("--per-capture", action="store_true", help="one analysis per file")
    extended.add_argument("--output", "-o", help="folder for the results")
    extended.add_argument("--format", choices=["json", "csv"], default="json")
    extended.add_argument("--series", help="folder for the chart series (parquet)")

    basic = commands.add_parser("basic", parents=[shared], help="9 features and text reports")
    basic.add_argument("path", nargs="?")
    basic.add_argument("--file", "-f")
    basic.add_argument("--sample", "-s", type=int, help="analyse this many packets")
    basic.add_argument("--output", "-o", help="folder for the reports and the projection (parquet)")
    basic.add_argument("--verbose", "-v", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "basic":
        args.path = args.path or args.file
        if args.path is None:
            parser.error("a path is needed, as an argument or with --file")
    return args


GLANCE = 50


def _report(title: str, frame: DataFrame, folder: str | None, order: list[str]) -> None:
    """Writes the whole report, sorted, as a table; prints its first rows, or all where nothing is written."""
    print(f"\n=== {title} ===")
    places = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c) for c in order]
    ordered = frame.orderBy(*places) if places else frame
    if folder:
        path = f"{folder}/{title.lower().replace(' ', '_')}"
        ordered.write.mode("overwrite").parquet(path)
        print(f"(whole report in {path})")
        ordered.show(GLANCE, truncate=False)
        return
    for row in ordered.toLocalIterator():
        print(" | ".join(f"{k}: {v}" for k, v in row.asDict().items() if v is not None))


def _write_series(analysis: Analysis, folder: str) -> None:
    found = series.components(analysis)
    frames = {
        "cluster_sizes": analysis.cluster_sizes(),
        "score_histogram": series.score_histogram(analysis),
        "feature_importance": series.feature_importance(analysis),
        "score_timeline": series.score_timeline(analysis),
        "length_against_score": series.length_against_score(analysis),
        "projection": series.projection(analysis, found),
        "projected_centres": series.projected_centres(analysis, found),
        "loadings": series.loadings(analysis, found, top=None),
    }
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def _refused(lists: PacketLists, folder: str | None) -> None:
    """Files that could not be read; the others are analysed."""
    if not lists.refused.isEmpty():
        _report("Refused files", lists.refused, folder, ["file"])


def _extended(spark: SparkSession, args: argparse.Namespace) -> None:
    # Parsed once; every later pass reads the columns it needs from the stored table.
    lists = read_lists(spark, args.paths, "extended", args.mode)
    packets = materialize(lists.packets, "parsed")
    by = ("capture_id",) if args.per_capture else ()
    analysis = fit(packets, profile=EXTENDED, by=by, k=args.clusters, percentile=args.threshold, trainer=args.trainer)
    if args.output and args.format == "json":
        sinks.write_json(analysis, args.output)
    elif args.output:
        sinks.write_csv(analysis, args.output)
    # Beside the results, as those replace their whole folder.
    reports = f"{args.output.rstrip('/')}-reports" if args.output else None
    _refused(lists, reports)
    _report("Summary", analysis.summary(), reports, list(by))
    if by:
        _report("Rejected", analysis.rejected, reports, list(by))
    if args.series:
        _write_series(analysis, args.series)


def _basic(spark: SparkSession, args: argparse.Namespace) -> None:
    lists = read_lists(spark, args.path, "basic", args.mode)
    packets = materialize(lists.packets, "parsed")
    _refused(lists, args.output)
    if args.sample:
        packets = sample_exact(packets, args.sample, ["capture_id", "frame_number"])
    _report("Traffic summary", traffic.traffic_summary(packets), args.output, ["section", "-packets", "item"])
    analysis = fit(
        packets, profile=BASIC, k=args.clusters, percentile=args.threshold, trainer=args.trainer,
        keep=("src_ip", "dst_ip", "protocol", "info", "packet_length"),
    )
    if args.verbose:
        print("\n=== Features ===")
        analysis.packets.select(*BASIC.features).show(5, truncate=False)
    _report("Clusters", clusters.cluster_profile(analysis, "packet_length"), args.output, ["cluster_id"])
    found = series.components(analysis)
    if args.output:
        series.projection(analysis, found).write.mode("overwrite").parquet(f"{args.output}/projection")
        series.projected_centres(analysis, found).write.mode("overwrite").parquet(f"{args.output}/centres")
    _report("Component loadings", series.loadings(analysis, found), args.output, ["component", "rank"])
    _report("Small clusters", anomalies.small_clusters(analysis), args.output, ["packets", "cluster_id"])
    _report("Anomaly report", anomalies.anomaly_report(analysis, "packet_length"), args.output, ["section", "-packets", "item"])
    _report("Small cluster samples", anomalies.small_cluster_samples(analysis, "packet_length"), args.output, ["cluster_id", "rank"])
    long = anomalies.long_packets(analysis.packets, length="packet_length")
    _report("First long packets", anomalies.first_lines(long, length="packet_length"), args.output, ["rank"])
    errors = anomalies.first_lines(anomalies.error_packets(analysis.packets), width=100, length=None)
    _report("First error packets", errors, args.output, ["rank"])


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    spark = SparkSession.builder.appName("packetweave").getOrCreate()
    try:
        (_extended if args.command == "extended" else _basic)(spark, args)
    except (AnalysisError, SourceError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

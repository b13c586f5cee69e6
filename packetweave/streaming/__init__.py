"""Structured Streaming jobs: live scoring, periodic refits, running counts."""

from packetweave.streaming.live import LiveScorer, Refitter, packet_stream, running_counts

from packetweave.streaming.lists import ListArrivals
from packetweave.streaming.refit import MergingRefitter

__all__ = ["ListArrivals", "LiveScorer", "MergingRefitter", "Refitter", "packet_stream", "running_counts"]

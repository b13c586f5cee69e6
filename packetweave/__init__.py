"""Packet-list clustering and anomaly analytics as Spark DataFrame jobs."""

from packetweave.operators.features import BASIC, EXTENDED
from packetweave.plans.analysis import Analysis, AnalysisError, fit, load

__all__ = ["Analysis", "AnalysisError", "BASIC", "EXTENDED", "fit", "load"]

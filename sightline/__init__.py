"""Spark-native appearance analytics: from timed detections to per-identity timelines."""

__version__ = "0.1.0"

"""Spark-native reading, matching and reconciling of purchasing paperwork."""

__version__ = "0.1.0"

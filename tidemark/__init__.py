"""Drift analytics for large, time-ordered tables on Spark."""

__version__ = "0.1.0"

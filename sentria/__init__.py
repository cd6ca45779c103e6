"""Adverse-event report analytics and signal detection on Spark DataFrames."""

__version__ = "0.1.0"

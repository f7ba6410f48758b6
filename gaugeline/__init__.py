"""Capture-measurement and ordinal-severity analytics on Spark DataFrames."""

__version__ = "0.1.0"

"""Keyed time-series analytics on Spark: series queries, storage, rollups, streams and data-preparation operators."""

__version__ = "0.1.0"

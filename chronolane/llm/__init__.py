"""Operators for training-data pipelines: event runs, quantile summaries, packing, mixing, shared spans.

Nothing else in the library imports this subpackage.
"""

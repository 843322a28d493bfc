"""Operators for training-data pipelines (nothing else in tidemill imports this subpackage)."""

"""Operators for training-data pipelines. Nothing outside this sub-package imports it."""

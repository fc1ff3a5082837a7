"""Operators for large-scale training-data pipelines over media text. Nothing outside this folder imports it."""

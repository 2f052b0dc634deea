"""Operators for training-data pipelines: one module for each, and their queries.

Nothing outside this package imports it.
"""

"""Operators for training-data pipelines: deduplication, filters, scans, models and formats.

Nothing else in the library imports this subpackage.
"""

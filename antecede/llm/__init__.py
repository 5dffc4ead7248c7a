"""Operators of a training-data pipeline: formatting, archives, deduplication, filters, scoring and packing.

Nothing outside this folder imports it, so it can be left out of an installation.
"""

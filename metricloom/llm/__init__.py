"""Operators of a training-data pipeline: packing, duplicates, quality, licences, leaks, models."""

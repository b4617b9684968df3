"""Governed retail metrics, series analysis, data quality, text audit and evaluation jobs on Spark."""

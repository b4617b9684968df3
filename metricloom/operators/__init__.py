"""Relational, series, quality, text and evaluation operators over DataFrames."""

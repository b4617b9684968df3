"""Metric catalog, star-schema bindings and the compiler from analysis plans to DataFrames."""

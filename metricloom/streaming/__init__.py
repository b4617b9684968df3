"""Structured Streaming versions of the append-only log operators."""

"""Named queries over the bench tables and the SQL that checks each of them."""

from __future__ import annotations

from registry import evaluation, metrics, nulls, quality, relational, series, streams, text

_MODULES = (metrics, relational, series, quality, text, evaluation, nulls, streams)


def all_queries() -> dict:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

"""Queries over the warehouse tables, each with the SQL that checks it."""

from __future__ import annotations


def all_queries() -> dict:
    from logloom.catalog import encoding, evaluation, features, learning, models, routing, samples, scaling, sources

    out: dict = {}
    for module in (features, scaling, encoding, samples, models, routing, evaluation, learning, sources):
        out.update(module.QUERIES)
    return out

"""Queries over the driver tables, each next to its SQL oracle."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "series_queries", "interval_queries", "session_queries", "density_queries",
    "propulsion_queries", "stats_queries", "model_queries", "feature_queries", "outcome_queries",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"{__name__}.{name}"), attribute).items():
            if key in merged:
                raise ValueError(f"query {key!r} is registered twice")
            merged[key] = value
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")

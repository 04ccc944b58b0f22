"""Registered queries with their check SQL, by area."""

from __future__ import annotations

import importlib

AREAS = ("ticks", "bars", "books", "joins", "selection", "regimes", "execution", "signals", "metrics", "weights",
         "streams", "files", "pipelines")


def catalog() -> dict:
    """Name to (query, SQL or None)."""
    found: dict = {}
    for area in AREAS:
        try:
            module = importlib.import_module(f"barloom.catalog.{area}")
        except ModuleNotFoundError as e:
            if e.name != f"barloom.catalog.{area}":
                raise
            continue
        overlap = found.keys() & module.QUERIES.keys()
        if overlap:
            raise ValueError(f"query names used twice: {sorted(overlap)}")
        found |= module.QUERIES
    return found

"""Registered queries: each module adds its own to the registry when it is imported."""

from __future__ import annotations

import importlib

MODULES = ["raster", "edits", "features", "integrity", "sky", "consumers", "generation", "streams", "files"]


def all_queries():
    for name in MODULES:
        importlib.import_module(f"gridloom.plans.{name}")
    from gridloom.registry import ORACLES, QUERIES

    return QUERIES, ORACLES

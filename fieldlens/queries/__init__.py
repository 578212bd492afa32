"""Registered queries over the supplied tables, with the SQL each must agree with."""

from __future__ import annotations

import importlib

MODULES = ["rates", "statistics", "relational", "sequences", "crops", "space", "rasters", "planning",
           "stores", "documents", "scalars", "streams"]


def load() -> dict:
    from fieldlens.queries.registry import REGISTRY
    for name in MODULES:
        importlib.import_module(f"fieldlens.queries.{name}")
    return REGISTRY

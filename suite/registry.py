"""Collects the registered queries of all sections."""

from __future__ import annotations

import importlib

SECTIONS = ["transforms", "inference", "shape", "orders", "records", "streams", "incremental"]


def all_queries() -> dict:
    found: dict = {}
    for section in SECTIONS:
        for name, pair in importlib.import_module(f"suite.{section}").QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = pair
    return found

"""Registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["exploration", "quality", "insight", "service", "learning"]


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"holdfast.catalog.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles

"""Registered queries of the training-data operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ["sharding", "scoring", "packing", "mixing", "quality", "ann", "chat", "lines",
           "urls", "neardup", "prefix_trie", "phrases", "secret_scan"]


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"holdfast.llm.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles

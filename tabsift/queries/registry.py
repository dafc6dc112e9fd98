"""All registered queries by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["functions", "profiling", "accuracy", "reuse", "triage", "files"]


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for module in (import_module(f"tabsift.queries.{m}") for m in MODULES):
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles

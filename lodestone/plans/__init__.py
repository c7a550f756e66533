"""Registered queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ingestion", "retrieval", "structured", "routing", "graph", "answers", "governance", "comparisons")


def queries() -> dict:
    from lodestone.plans.registry import QUERIES

    for name in MODULES:
        import_module(f"lodestone.plans.{name}")
    return dict(QUERIES)


def oracles() -> dict:
    from lodestone.plans.registry import ORACLES

    queries()
    return dict(ORACLES)

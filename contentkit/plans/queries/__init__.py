"""Registered queries: every operator bound to the driver tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from contentkit.plans.queries.base import REGISTRY

MODULES = (
    "catalog", "merging", "quality", "rollups", "pages", "extraction", "detectors", "schemas", "conforming", "converting", "files",
)


def load() -> dict:
    """Name to (query, SQL or None) for all modules."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return REGISTRY

"""All registered queries; importing a module registers its queries."""

from __future__ import annotations

import importlib

MODULES = ("joins", "scalars", "windows", "analytics", "corpus", "streams")


def load():
    """Import every catalog module and return (queries, oracles)."""
    from tapelab.plans import registry

    for name in MODULES:
        importlib.import_module(f"tapelab.plans.catalog.{name}")
    return registry.QUERIES, registry.ORACLES

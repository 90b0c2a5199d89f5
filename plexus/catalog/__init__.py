"""All queries of the graph engine by name, with SQL for each that SQL can express."""

from __future__ import annotations

from importlib import import_module

from plexus.catalog.base import ORACLES, QUERIES

MODULES = ("expansion", "overlays", "filtering", "matching", "cycles", "ranking", "batch", "lookup")

for _name in MODULES:
    import_module(f"plexus.catalog.{_name}")


def flagship(spark, sf_dir):
    """Customers' orders with all their parts, overlap overlaid, matched, scored and sorted."""
    return QUERIES["flagship"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]

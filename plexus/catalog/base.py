"""The register that the catalog modules fill."""

from __future__ import annotations

from collections.abc import Callable

from plexus.sources import lens

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = "", recursive: bool = False) -> Callable:
    """Register a query; ``sql`` is a select over the tables, the lens (``nodes, edges, ontology``) and ``ctes``."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            more = f",\n{ctes}" if ctes else ""
            ORACLES[name] = f"with{' recursive' if recursive else ''} {lens.SQL.strip()}{more}\n{sql}"
        return f

    return add

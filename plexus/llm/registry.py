"""The corpus queries and their SQL, gathered from the operator modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontaminate", "mix", "rules", "resample", "jaccard", "shard", "tokens", "quotes", "licenses", "urls", "divergence", "pieces", "trie")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"plexus.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

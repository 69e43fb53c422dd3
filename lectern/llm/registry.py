"""The subpackage's queries, by the names that the entry module registers."""

from __future__ import annotations

from importlib import import_module

MODULES = ("vector_dedup", "quality", "jaccard", "language", "licenses", "token_count", "decontaminate", "urls", "mixture", "secrets", "negatives", "lexical", "packing")
QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _module = import_module(f"lectern.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})

"""Registered queries over the star-schema tables, and the SQL that states the same results."""

from __future__ import annotations

from lectern.plans import learning, marts, online, storage, tables

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (tables, learning, marts, online, storage):
    QUERIES |= _module.book.queries
    ORACLES |= _module.book.oracles

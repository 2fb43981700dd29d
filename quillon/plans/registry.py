"""Queries over the engine's own operators and their DuckDB SQL, by name."""

from __future__ import annotations

from quillon.plans import changes, evidence, files, operations, research, search

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (search, research, evidence, operations, changes, files):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

"""Operators for large training-data pipelines, one module per problem; nothing outside imports this package.

Each problem module has its operator, ``QUERIES`` (name -> function of session and folder) and,
where DuckDB can say the same, ``ORACLES`` (name -> SQL).
"""

from __future__ import annotations

import importlib

MODULES = ("groups", "clusters", "reference", "neighbours", "splits", "survivors", "tokens", "mixing", "lookalikes")


def queries() -> dict:
    """All pN_ queries, in the order of the problems."""
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"{__name__}.{name}").QUERIES
    return out


def oracles() -> dict[str, str]:
    """The SQL of those queries that have one."""
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{name}"), "ORACLES", {})
    return out

"""Queries on the given tables, and the SQL each of them is checked against."""

from __future__ import annotations

from importlib import import_module

from vitalspan.catalog.base import ORACLES, QUERIES, Query

MODULES = ["series", "cohort", "stats", "parsing", "modelling", "signals", "composites", "stages"]


def _load() -> None:
    for name in MODULES:
        import_module(f"vitalspan.catalog.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)

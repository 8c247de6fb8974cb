"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["names", "places", "linkage", "survivor", "components", "leaks", "mixing", "residue"]


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"demesne.llm.{name}"), what))
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")

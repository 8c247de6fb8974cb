"""Registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules with ``QUERIES`` (name -> callable) and ``SQL`` (name -> text).
MODULES = ["q_metrics", "q_relational", "q_data", "q_er", "q_graph", "q_more", "q_retrieval", "q_results", "q_archive", "q_streaming", "q_problems"]


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"demesne.plans.{name}"), what)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict[str, Query]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")

"""Queries over the shared test tables, one per operator, with the same question in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("warehouse", "joins", "scoring", "statistics", "network", "trade", "panels", "fleet", "ingest", "streams", "live", "chain")


def _load() -> None:
    for m in MODULES:
        import_module(f"wattline.checks.{m}")


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from wattline.checks.base import QUERIES

    _load()
    return dict(QUERIES)


def registered_sql() -> dict[str, str]:
    from wattline.checks.base import SQL

    _load()
    return dict(SQL)

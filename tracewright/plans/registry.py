"""The queries of the core, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package that hold QUERIES and SQL.
MODULES: tuple[str, ...] = ("scan", "text", "findings", "bugs", "status", "upkeep", "pipelines")


def core_queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in import_module(f"{__package__}.{m}").QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in import_module(f"{__package__}.{m}").SQL.items()}

"""Every core query and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("problems", "reference", "more")


def _modules():
    return [import_module(f"quillon.queries.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in _modules():
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in _modules():
        found.update(module.ORACLES)
    return found

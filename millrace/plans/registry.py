"""Every query of the library by name, and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("reads", "scalars", "flows", "web", "crawl", "night")


def _plans():
    return [import_module(f"millrace.plans.{name}").plans for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plans in _plans() for name, f in plans.found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plans in _plans() for name, sql in plans.sql.items()}

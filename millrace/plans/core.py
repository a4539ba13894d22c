"""How a query is declared: a name, a function of the directory's tables, and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.directory import Directory, with_tables


@dataclass
class Plans:
    """The queries of one module. ``tables``: directory tables that the oracle SQL names; without SQL a query is checked by its tests only."""

    found: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, body: str | None = None, tables: tuple[str, ...] = ()):
        def add(f: Callable[[Directory], DataFrame]) -> Callable[[Directory], DataFrame]:
            if name in self.found:
                raise ValueError(f"two queries are named {name}")
            self.found[name] = lambda spark, sf_dir: f(Directory(spark, sf_dir))
            if body is not None:
                self.sql[name] = with_tables(tables, body) if tables else body
            return f

        return add

"""Named queries, each with the survey line it covers and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spanloom.session import ship_package
from spanloom.sources.fixtures import oracle_with


@dataclass(frozen=True)
class Entry:
    name: str
    lines: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    text: str | None

    @property
    def sql(self) -> str | None:
        """Self-contained oracle SQL; fixture tables are resolved when asked for."""
        return oracle_with(self.text) if self.text else None


ENTRIES: dict[str, Entry] = {}


def query(name: str, *lines: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)``; ``sql`` may name any fixture table."""

    def wrap(fn):
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        ENTRIES[name] = Entry(name, lines, run, sql)
        return fn

    return wrap

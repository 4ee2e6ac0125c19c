"""The queries: a name, a plan builder and, where SQL can say the same, its SQL for checking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """One registered query; ``sql`` is null where plain SQL cannot express it or is too slow on whole tables."""

    name: str
    build: Builder
    sql: str | None


class Registry:
    """Queries by name, in the order they were added."""

    def __init__(self) -> None:
        self.items: dict[str, Query] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        """Register the decorated builder under ``name``."""

        def add(build: Builder) -> Builder:
            if name in self.items:
                raise ValueError(f"query {name} is registered twice")
            self.items[name] = Query(name, build, sql)
            return build

        return add

    def builders(self) -> dict[str, Builder]:
        return {n: q.build for n, q in self.items.items()}

    def sql(self) -> dict[str, str]:
        return {n: q.sql for n, q in self.items.items() if q.sql}

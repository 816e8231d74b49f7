"""Registry of the engine's queries: name, operators of the inventory, Spark query, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from blocklens.runtime import ship
from blocklens.sources.chainview import Views, with_views


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    build: Callable[[Views], DataFrame]
    sql: str | None

    def __call__(self, spark, sf_dir: str) -> DataFrame:
        ship(spark)
        return self.build(Views(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(ops: str, sql: str | None = None, views: str = ""):
    """Register a function (Views) -> DataFrame under its own name; views: chain views that the SQL reads."""

    def add(build):
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, ops, build, with_views(sql, views.split()) if sql else None)
        return build

    return add

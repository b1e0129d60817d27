"""Where checks register themselves, and how a SQL text gets the views it uses."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordlake.operators.skew import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``views`` names the SQL views that ``sql`` reads, in any order."""
    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(views, sql)
        return fn

    return register


def with_views(names: str, sql: str) -> str:
    from .views import SQL_VIEWS

    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        uses, _ = SQL_VIEWS[name]
        for other in uses.split():
            add(other)
        needed.append(name)

    for name in names.split():
        add(name)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in needed) + "\n" + sql


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors can reach."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

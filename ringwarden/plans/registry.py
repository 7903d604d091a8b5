"""Where queries and their checking SQL are registered side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .sql_views import compose

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(
    name: str, views: str = "", sql: str | None = None, replaced: dict[str, str] | None = None
) -> Callable[[Run], Run]:
    """Register ``fn(spark, folder)``; ``sql`` may use the named views as tables."""

    def register(fn: Run) -> Run:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        CATALOG[name] = Query(name, run, None if sql is None else compose(views.split(), sql, replaced))
        return fn

    return register

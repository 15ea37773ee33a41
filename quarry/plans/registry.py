"""Registry of named queries: a Spark builder plus optional oracle SQL.

``register(name, sql)`` attaches a builder ``fn(spark, sf_dir) -> DataFrame``
and the DuckDB SQL that must give the same rows.  Builders without SQL are
checked rows-only (their semantics are order dependent or iterative) and
have property tests in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every module that registers queries, then return the registry."""
    from quarry.plans import catalog  # noqa: F401  (registers on import)
    return REGISTRY

"""Registry of named corpus queries and their DuckDB oracles.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Its oracle is DuckDB SQL over
the driver tables (the derived views are prefixed by ``with_views``); an
operator without a SQL equivalent registers no oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from progcorpus.sources.fixtures import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn`` as query ``name``; ``sql`` is the oracle's final
    SELECT, ``ctes`` extra ``name AS (...)`` definitions it needs."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, ctes)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from progcorpus.plans import corpus_queries, node_queries, token_queries  # noqa: F401


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLES)

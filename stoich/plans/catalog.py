"""Registry of the named queries: a Spark callable ``(spark, sf_dir) ->
DataFrame`` and, where the operation is expressible in SQL, the DuckDB oracle
over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL string."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def load_all() -> None:
    """Import every query module (they register on import)."""
    from stoich.plans import (q_composition, q_corpus, q_io, q_ml, q_models,  # noqa: F401
                              q_results, q_sampling, q_search)

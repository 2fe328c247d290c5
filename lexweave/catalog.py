"""The engine's registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans import engine_queries, entity_queries, entity_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*entity_queries.QUERIES, *engine_queries.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return entity_sql.SQL | engine_queries.SQL

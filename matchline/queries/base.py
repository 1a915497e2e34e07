"""Registration of queries: a name, a callable of (spark, sf_dir), and DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures
from ..sources.stored import shared_folder, written  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a callable. sql follows the fixtures' CTEs: more CTEs (`x AS (...), ...`) and a SELECT."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            ORACLE_SQL[name] = f"WITH {fixtures.SQL.strip()}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
        return f

    return add

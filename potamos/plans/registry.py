"""All named queries of the library's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from potamos.sources.derived import Tables, duckdb_with

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(tables)`` under a name. ``uses`` names the derived tables that the SQL reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if uses:
                head = duckdb_with(uses)
                text = f"{head}, {text[5:]}" if text.startswith("WITH ") else f"{head} {text}"
            elif text.startswith("WITH "):
                text = "WITH RECURSIVE " + text[5:]
            _SQL[name] = text
        return fn

    return register


def _load() -> None:
    from potamos.plans import aggregate_queries, cell_queries, graph_queries, join_queries, source_queries, stream_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["o_g29_route_sum"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

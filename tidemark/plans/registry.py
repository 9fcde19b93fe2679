"""Registered queries: a Spark form over the given tables and its SQL check."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.fixtures import Shapes, duckdb_query

Query = Callable[[Shapes], DataFrame]

_QUERIES: dict[str, Query] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``check`` is the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if check is not None:
            _CHECKS[name] = check
        return fn

    return add


def _load() -> None:
    from tidemark.plans import queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Shapes(spark, folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def checks() -> dict[str, str]:
    _load()
    return {name: duckdb_query(text) for name, text in _CHECKS.items()}

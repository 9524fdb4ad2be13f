"""The registry of queries: name, DataFrame plan, and the same result in SQL where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("logs", "detection", "problems", "state", "reports", "inputs", "stores")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan under its function's name."""

    def register(f: Query) -> Query:
        name = f.__name__
        if name in _QUERIES and _QUERIES[name].__module__ != f.__module__:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def load_sql(name: str) -> str:
    """The SQL of a query that is registered already, for another way to the same result."""
    return _SQL[name]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for m in _MODULES:
        importlib.import_module(f"emberlog.plans.{m}")
    return dict(_QUERIES), dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

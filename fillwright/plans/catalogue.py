"""The registry of queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("scores", "prompts", "corpora", "training", "generation", "files", "runs")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL of the same result."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load() -> None:
    for name in _MODULES:
        import_module(f"fillwright.plans.{name}")

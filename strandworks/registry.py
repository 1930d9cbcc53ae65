"""Queries and their SQL twins, gathered from the modules that register them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Modules that register queries when imported.
MODULES: tuple[str, ...] = (
    "strandworks.functions.scalar",
    "strandworks.operators.select",
    "strandworks.operators.lapped",
    "strandworks.operators.quant",
    "strandworks.operators.gain",
    "strandworks.operators.frames",
    "strandworks.operators.labels",
    "strandworks.operators.evaluate",
    "strandworks.operators.headers",
    "strandworks.operators.entropy",
    "strandworks.operators.spectral",
    "strandworks.operators.geometry",
    "strandworks.operators.asof",
    "strandworks.operators.sketches",
    "strandworks.plans.compress",
    "strandworks.plans.frames",
    "strandworks.sources.segy",
    "strandworks.sources.syz",
    "strandworks.sources.blocks",
    "strandworks.sources.wav",
    "strandworks.sources.records",
    "strandworks.streaming.streams",
    "strandworks.streaming.stateful",
    "strandworks.learning.training",
    "strandworks.learning.draws",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, folder) -> DataFrame and, where SQL can express it, its twin in DuckDB's SQL."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL

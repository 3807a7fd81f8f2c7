"""Named query registry feeding ``__spark_entry__`` (Spark query + DuckDB oracle SQL)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    oracle: str | None
    bench: bool = False


_REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, bench: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"query '{name}' is already registered")
        _REGISTRY[name] = Entry(name, fn, oracle, bench)
        return fn
    return deco


def entries() -> dict[str, Entry]:
    from . import catalog  # noqa: F401  (registers on import)
    return dict(_REGISTRY)

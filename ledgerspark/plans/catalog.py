"""Registered queries: one Spark DataFrame query per inventory item, each paired
(where SQL can say it) with equivalent DuckDB SQL over the same base tables.

Every query reads the shared tables (or views Spark derives from them) in full.
Doubles are rounded to 6 places on both sides so results hash identically.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    items: str  # SURVEY inventory ids covered


REGISTRY: dict[str, Query] = {}


def register(name: str, items: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, items)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills the registry
    from ledgerspark.plans import q_features, q_imputation, q_io, q_ml, q_profile, q_quality  # noqa: F401
    return REGISTRY

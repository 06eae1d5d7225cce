"""Registry of named queries: a Spark builder and, where SQL can express it,
an independent DuckDB oracle over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.sources.tables import with_payments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, payments: bool = True):
    """Decorator: ``oracle`` is DuckDB SQL; the payments CTE is prefixed
    unless ``payments=False``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_payments(oracle) if payments else oracle.strip()
        return fn
    return deco

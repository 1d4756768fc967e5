"""Registered query plans: every operator as a ``(spark, sf_dir) -> DataFrame``
builder over the driver tables, paired with an independent DuckDB SQL oracle.

The builders live in the area modules (``catalog``, ``filtering``, ...); importing
this package registers all of them.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read a driver table (filters and projections reach the parquet scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _load_all() -> None:
    from tablescope.plans import (catalog, filtering, browsing, faceting, profiling,  # noqa: F401
                                  prediction, junkcheck, tiling, timelines, sequences,
                                  series, formatting, eventlog)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)

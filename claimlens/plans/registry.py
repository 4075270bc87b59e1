"""Registry of named queries and their DuckDB oracles.

Each plan module registers ``key -> fn(spark, sf_dir) -> DataFrame`` and, when
the operator is expressible in SQL, the equivalent DuckDB query.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from claimlens.session import ship_package, stage_path

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str):
            ship_package(spark)  # executors import claimlens from the shipped zip
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def r6(c) -> Column:
    """Doubles leave every query rounded to 6 places (same rule in SQL)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh folder for a written stage table under the shared checkpoint dir."""
    return stage_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")

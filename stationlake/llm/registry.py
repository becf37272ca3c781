"""Registered corpus queries: callables over (spark, folder) and DuckDB texts where SQL can say it."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def let_workers_import(spark: SparkSession) -> None:
    """Python workers of this session find the package where the driver found it.

    A cluster ships it with ``--py-files``; on one machine the driver may have got it from a
    path that its workers do not inherit.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under a name, with its oracle if there is one."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            let_workers_import(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, all rows."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

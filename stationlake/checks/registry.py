"""Registered queries: each name has a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.checks.fixtures import Tables, duckdb_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``function(tables)`` under a name, with its oracle over fixture views."""

    def register(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            prefix = duckdb_views(*views) if views else ""
            text = sql.strip()
            if prefix and text.upper().startswith("WITH "):
                prefix, text = prefix + ",", text[5:]
            ORACLES[name] = f"{prefix} {text}".strip()
        return function

    return register


def rounded(frame: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """Doubles rounded for comparison: engines add numbers in different order."""
    return frame.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def plain_times(frame: DataFrame) -> DataFrame:
    """Instants as zone-less UTC timestamps, the form the oracle returns."""
    types = dict(frame.dtypes)
    return frame.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in frame.columns if types[c] == "timestamp"}
    )

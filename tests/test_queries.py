"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = sorted(p.stem for p in Path(FOLDER).glob("*.parquet"))


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda n: names[n])
    return sorted((tuple(plain(row[n]) for n in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query_matches_oracle(spark, oracle, name):
    result = entry_point.queries()[name](spark, FOLDER)
    rows = result.collect()
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    reply = oracle.execute(sql)
    names = [column[0] for column in reply.description]
    assert sorted(names) == sorted(result.columns)
    assert table(result.columns, rows) == table(names, reply.fetchall())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).take(1)

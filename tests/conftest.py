"""Shared session and helpers."""

from __future__ import annotations

import datetime as dt
import gzip
import uuid
from pathlib import Path

import pytest

from stationlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("stationlake-tests", cores="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def folder():
    """A new folder per test; nothing is cleared afterwards."""
    path = Path("/tmp/spark-stationlake-tests") / uuid.uuid4().hex
    path.mkdir(parents=True)
    return path


FACT_FIELDS = (
    "department string, network_category string, year int, NUM_POSTE string, NOM_USUEL string, LAT double, "
    "LON double, ALTI int, observation_time_utc timestamp, T float, QT smallint, RR1 float, QRR1 smallint"
)


def hour(text: str) -> dt.datetime:
    return dt.datetime.strptime(text, "%Y-%m-%d %H").replace(tzinfo=dt.timezone.utc)


def make_facts(spark, rows):
    """Facts from (department, station, name, hour, value, code) tuples."""
    from pyspark.sql import functions as F

    from stationlake.functions import timeops

    places = {name: 45.0 + n for n, name in enumerate(sorted({r[2] for r in rows}))}
    full = [
        (
            department, "main", hour(time).year, station, name, places[name], 1.0, 10, hour(time), value, code,
            None if value is None else value / 10, code,
        )
        for department, station, name, time, value, code in rows
    ]
    facts = spark.createDataFrame(full, FACT_FIELDS)
    instant = F.col("observation_time_utc")
    return facts.withColumns(
        {"local_date": timeops.local_date(instant), "local_hour": timeops.local_hour(instant)}
    )


def write_gzip(path: Path, lines: list[str], encoding: str = "utf-8") -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt", encoding=encoding, newline="") as output:
        output.write("\n".join(lines) + ("\n" if lines else ""))
    return path

"""Paris civil time against the standard library."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from stationlake.functions import timeops, values

PARIS = ZoneInfo("Europe/Paris")


def test_offsets_and_daylight_saving_since_1900(spark):
    # Every seventh hour from 1900 to 2030 visits all transitions closely.
    start, end = -613_600, 526_000
    instants = spark.range(start, end, 7).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("t"))
    instant = F.col("t")
    rows = instants.select(
        "id",
        timeops.utc_offset_minutes(instant).alias("offset"),
        timeops.is_dst(instant).alias("dst"),
        timeops.local_hour(instant).alias("hour"),
    ).toPandas()
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    for number, offset, dst, hour in rows.itertuples(index=False):
        local = (epoch + dt.timedelta(hours=int(number))).astimezone(PARIS)
        expected = (int(local.utcoffset().total_seconds() / 60), bool(local.dst()), local.hour)
        assert (offset, dst, hour) == expected, local


def test_raw_times(spark):
    texts = ["2024033101", "2024023000", "2024010124", "abc", "", None, "202401011", "20240101011"]
    frame = spark.createDataFrame([(t,) for t in texts], "raw string")
    valid = [r[0] for r in frame.select(timeops.is_valid_time(F.col("raw"))).collect()]
    assert valid == [True] + [False] * 7


def test_metric_conversion_truncates_and_checks_ranges(spark):
    frame = spark.createDataFrame([("2.7",), ("-0.4",), ("-1",), ("65536",), ("",), ("nan",), ("x",)], "v string")
    rows = frame.select(
        values.convert_metric(F.col("v"), "DD").alias("whole"), values.is_bad_metric(F.col("v"), "DD").alias("bad")
    ).collect()
    assert [r.whole for r in rows] == [2, 0, None, None, None, None, None]
    assert [r.bad for r in rows] == [False, False, True, True, False, True, True]


def test_labels_units_and_codes(spark):
    frame = spark.createDataFrame([("UV_INDICE",), ("FXI3S",), ("HFXI3S",)], "n string")
    assert [r[0] for r in frame.select(values.title_words(F.col("n"))).collect()] == [
        "Uv Indice", "Fxi3S", "Hfxi3S",
    ]
    unit = spark.createDataFrame([("vent (en m/s et 1/10)",), ("rien",), (None,)], "d string")
    assert [r[0] for r in unit.select(values.official_unit(F.col("d"))).collect()] == ["m/s et 1/10", None, None]
    codes = spark.createDataFrame([("2A",), ("01",), ("95",), ("96",), ("971",), ("X",)], "c string")
    assert [r[0] for r in codes.select(values.is_metropolitan(F.col("c"))).collect()] == [
        True, True, True, False, False, False,
    ]

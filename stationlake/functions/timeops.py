"""Civil time: parsing, Paris wall clock, offsets, daylight saving, expected hours.

All functions build ``Column`` expressions and assume the session zone is UTC.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationlake.schema import LOCAL_ZONE

RAW_TIME_FORMAT = "yyyyMMddHH"

# Instants (UTC) at which the meaning of a Paris offset changed.
OCCUPATION_START = "1940-06-14 22:00:00"
LIBERATION = "1944-08-24 22:00:00"
POSTWAR_STANDARD = "1945-09-16 01:00:00"


def parse_observation_time(raw: Column) -> Column:
    """``YYYYMMDDHH`` as a UTC instant; NULL when it is no valid hour."""
    return F.when(
        raw.rlike("^[0-9]{10}$"), F.try_to_timestamp(raw, F.lit(RAW_TIME_FORMAT))
    )


def hour_of_year(instant: Column) -> Column:
    """Number of an hour in its UTC year, from 0."""
    return ((F.dayofyear(instant) - 1) * 24 + F.hour(instant)).cast("bigint")


def is_valid_time(raw: Column) -> Column:
    return F.coalesce(parse_observation_time(raw).isNotNull(), F.lit(False))


def local_wall_clock(instant: Column) -> Column:
    """Paris wall clock as a timestamp without zone."""
    return F.from_utc_timestamp(instant, LOCAL_ZONE).cast("timestamp_ntz")


def utc_wall_clock(instant: Column) -> Column:
    return instant.cast("timestamp_ntz")


def local_date(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, LOCAL_ZONE))


def local_hour(instant: Column) -> Column:
    return F.hour(F.from_utc_timestamp(instant, LOCAL_ZONE)).cast("smallint")


def utc_offset_minutes(instant: Column) -> Column:
    """Whole minutes east of UTC, truncated (local mean time was 9 min 21 s)."""
    local = F.from_utc_timestamp(instant, LOCAL_ZONE)
    seconds = F.unix_timestamp(local) - F.unix_timestamp(instant)
    return (seconds / 60).cast("smallint")


def is_dst(instant: Column) -> Column:
    """Whether the Paris offset contains a daylight-saving hour.

    The base offset was UTC before the occupation, UTC+1 during it and since
    September 1945, and every hour between the liberation and then was DST.
    """
    offset = utc_offset_minutes(instant)
    return (
        F.when(instant < F.lit(OCCUPATION_START).cast("timestamp"), offset == 60)
        .when(instant < F.lit(LIBERATION).cast("timestamp"), offset == 120)
        .when(instant < F.lit(POSTWAR_STANDARD).cast("timestamp"), F.lit(True))
        .otherwise(offset == 120)
    )


def day_of(time_basis: str, instant: str = "observation_time_utc") -> Column:
    """Calendar day of an observation in the chosen time basis."""
    if time_basis == "local":
        return F.col("local_date")
    if time_basis == "utc":
        return F.to_date(F.col(instant))
    raise ValueError("Time basis must be local or utc")


def hour_of(time_basis: str, instant: str = "observation_time_utc") -> Column:
    """Hour of day of an observation in the chosen time basis."""
    if time_basis == "local":
        return F.col("local_hour")
    if time_basis == "utc":
        return F.hour(F.col(instant)).cast("smallint")
    raise ValueError("Time basis must be local or utc")


def wall_clock_of(time_basis: str, instant: str = "observation_time_utc") -> Column:
    if time_basis == "local":
        return local_wall_clock(F.col(instant))
    if time_basis == "utc":
        return utc_wall_clock(F.col(instant))
    raise ValueError("Time basis must be local or utc")


def month_day(day: Column) -> Column:
    """Calendar-day key; 29 February has its own."""
    return F.date_format(day, "MM-dd")


def expected_hours(start: Column, end: Column, time_basis: str) -> Column:
    """Hours in an inclusive date range; local days have 23 to 25 hours."""
    after = F.date_add(end, 1)
    if time_basis == "utc":
        return (F.datediff(after, start) * 24).cast("bigint")
    if time_basis != "local":
        raise ValueError("Time basis must be local or utc")
    begin_utc = F.to_utc_timestamp(start.cast("timestamp"), LOCAL_ZONE)
    end_utc = F.to_utc_timestamp(after.cast("timestamp"), LOCAL_ZONE)
    return ((F.unix_timestamp(end_utc) - F.unix_timestamp(begin_utc)) / 3600).cast("bigint")


def expected_year_hours(year: Column) -> Column:
    """8760, or 8784 in a leap year."""
    first, one = year.cast("int"), F.lit(1)
    return F.datediff(F.make_date(first + 1, one, one), F.make_date(first, one, one)) * 24


def span_seconds(first: Column, last: Column) -> Column:
    """Whole clock seconds between two instants."""
    return F.unix_timestamp(last) - F.unix_timestamp(first)


def day_literal(day: dt.date) -> Column:
    return F.lit(day.isoformat()).cast("date")


def instant_literal(day: dt.date) -> Column:
    """Midnight UTC of a day."""
    return F.lit(day.isoformat()).cast("timestamp")

"""Station metadata: history ranges, latest attributes, selection lists.

Text values never sit in an aggregation buffer of the big pass: Spark would sort
the input for that.  Observations are first reduced by hash aggregation to one
row per distinct attribute tuple (the station history), and "latest" values are
picked from those few rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions import timeops
from stationlake.operators.selection import Selection, in_period, quality_rule
from stationlake.schema import METRICS

ATTRIBUTES = ("NOM_USUEL", "LAT", "LON", "ALTI")
INSTANT = "observation_time_utc"


def latest(value: str, order: str) -> Column:
    """Value at the greatest order key, skipping NULL values."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def attribute_ranges(facts: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """First and last time of every distinct attribute tuple per key."""
    return facts.groupBy(*keys, *ATTRIBUTES).agg(
        F.min(INSTANT).alias("first_observation_utc"),
        F.max(INSTANT).alias("last_observation_utc"),
        *aggregates,
    )


def latest_attributes(ranges: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Latest attributes and the whole time span per key."""
    return ranges.groupBy(*keys).agg(
        *[latest(name, "last_observation_utc").alias(name) for name in ATTRIBUTES],
        F.min("first_observation_utc").alias("first_observation_utc"),
        F.max("last_observation_utc").alias("last_observation_utc"),
        *aggregates,
    )


STATION_KEYS = ("network_category", "NUM_POSTE")


def station_ranges(facts: DataFrame) -> DataFrame:
    """The one pass over facts that both station tables come from."""
    return attribute_ranges(facts, [*STATION_KEYS, "department"])


def history_of(ranges: DataFrame) -> DataFrame:
    """Every metadata tuple a station ever had, with its first and last time.

    A tuple that returns later gives one range that covers both uses.
    """
    return ranges.groupBy(*STATION_KEYS, *ATTRIBUTES).agg(
        F.min("first_observation_utc").alias("first_observation_utc"),
        F.max("last_observation_utc").alias("last_observation_utc"),
    )


def dimension_of(ranges: DataFrame) -> DataFrame:
    """One row per station: latest attributes, span, departments, variants."""
    return latest_attributes(
        ranges,
        STATION_KEYS,
        F.array_sort(F.collect_set("department")).alias("source_departments"),
        F.count_distinct("NOM_USUEL").alias("name_variant_count"),
        F.count_distinct(F.struct("LAT", "LON", "ALTI")).alias("location_variant_count"),
    )


def station_history(facts: DataFrame) -> DataFrame:
    return history_of(station_ranges(facts))


def station_dimension(facts: DataFrame) -> DataFrame:
    return dimension_of(station_ranges(facts))


def stations_for_period(
    facts: DataFrame, start: dt.date, end: dt.date, time_basis: str = "local",
    department: str | None = None,
) -> DataFrame:
    """Stations with any observation in a period, ordered for a selection list."""
    rows = facts.where(in_period(start, end, time_basis))
    if department is not None:
        rows = rows.where(F.col("department") == department)
    stations = latest_attributes(attribute_ranges(rows, ["NUM_POSTE"]), ["NUM_POSTE"])
    return stations.orderBy(F.asc_nulls_last("NOM_USUEL"), "NUM_POSTE")


def period_counts(selection: Selection) -> list[Column]:
    """Rows and usable metric values of the selected period, as aggregates."""
    inside = in_period(selection.start, selection.end, selection.time_basis)
    usable = inside & quality_rule(selection.metric, selection.quality_mode)
    return [
        F.count(F.when(inside, 1)).alias("period_rows"),
        F.count(F.when(usable, selection.value)).alias("metric_rows"),
    ]


def rank_stations(facts: DataFrame, selection: Selection) -> DataFrame:
    """Stations active in the period with the keys that make one the best.

    History span and period counts come from one pass over the history, where a
    join of two aggregates would read it twice.
    """
    rows = facts if selection.department is None else facts.where(
        F.col("department") == selection.department
    )
    stations = rows.groupBy("NUM_POSTE").agg(
        F.min(INSTANT).alias("first_observation"),
        F.max(INSTANT).alias("last_observation"),
        *period_counts(selection),
    )
    span = timeops.span_seconds(F.col("first_observation"), F.col("last_observation"))
    return stations.where("period_rows > 0").withColumn("history_seconds", span)


def best_station(facts: DataFrame, selection: Selection) -> DataFrame:
    """The station with most values, then longest history, then lowest code."""
    return (
        rank_stations(facts, selection)
        .orderBy(F.desc("metric_rows"), F.desc("history_seconds"), F.asc("NUM_POSTE"))
        .limit(1)
    )


def year_bounds(
    facts: DataFrame, department: str | None = None, time_basis: str = "local"
) -> DataFrame:
    """First and last day of every calendar year with data per department, newest first."""
    rows = facts if department is None else facts.where(F.col("department") == department)
    days = rows.select("department", timeops.day_of(time_basis).alias("day"))
    return (
        days.groupBy("department", F.year("day").alias("observation_year"))
        .agg(F.min("day").alias("first_date"), F.max("day").alias("last_date"))
        .orderBy("department", F.desc("observation_year"))
    )


def calendar_ranges(bounds: DataFrame) -> DataFrame:
    """Selectable range per department and year: whole years, the newest up to its last day."""
    years = F.collect_list(F.struct("observation_year", "first_date", "last_date"))
    # At most one entry per calendar year meets here.
    gathered = bounds.groupBy("department").agg(
        F.max("observation_year").alias("newest_year"), years.alias("years")
    )
    year = F.col("observation_year")
    end = F.when(year == F.col("newest_year"), F.col("last_date")).otherwise(
        F.make_date(year, F.lit(12), F.lit(31))
    )
    return gathered.select("department", "newest_year", F.inline("years")).select(
        "department",
        "observation_year",
        F.make_date(year, F.lit(1), F.lit(1)).alias("start_date"),
        end.alias("end_date"),
    )


def calendar_year_range(
    facts: DataFrame, department: str, year: int, time_basis: str = "local"
) -> tuple[dt.date, dt.date]:
    """Selectable range of one year of a department."""
    rows = calendar_ranges(year_bounds(facts, department, time_basis)).collect()
    if not rows:
        raise ValueError(f"Department {department} has no observations")
    for row in rows:
        if row.observation_year == year:
            return row.start_date, row.end_date
    raise ValueError(f"Department {department} has no observations in {year}")


def available_departments(departments: DataFrame, facts: DataFrame) -> DataFrame:
    """Known departments that have facts, ordered by code."""
    present = facts.select("department").distinct()
    return (
        departments.join(present, "department", "left_semi")
        .select("department", "department_name")
        .orderBy("department")
    )


def metric_documentation(spark, metrics: DataFrame) -> DataFrame:
    """The selectable metrics with their official description, where one exists."""
    selectable = spark.createDataFrame(
        [
            (m.name, m.label, m.unit, m.quality, list(m.statistics), list(m.default_statistics))
            for m in METRICS.values()
        ],
        "mnemonic string, label string, unit string, quality string, "
        "daily_statistics array<string>, default_daily_statistics array<string>",
    )
    official = metrics.where(F.col("source_mnemonic").isin(*METRICS)).select(
        F.col("source_mnemonic").alias("mnemonic"),
        F.col("official_description_fr").alias("description_fr"),
        "documentation_source",
    )
    return selectable.join(official, "mnemonic", "left")

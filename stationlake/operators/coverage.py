"""Coverage summaries, station maps and the temperature overview."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions import timeops, values
from stationlake.operators.selection import (
    ResultTooLarge,
    Selection,
    check_quality_mode,
    filter_observations,
    in_period,
    quality_rule,
)
from stationlake.operators.series import date_series
from stationlake.operators.stations import (
    ATTRIBUTES,
    attribute_ranges,
    latest,
    latest_attributes,
    period_counts,
)

DEFAULT_DAILY_HOURS = 18
HOURS = range(24)


def selection_hours(selection: Selection):
    """Expected hours of the selected period as a constant column."""
    return timeops.expected_hours(
        timeops.day_literal(selection.start), timeops.day_literal(selection.end), selection.time_basis
    )


def coverage_summary(facts: DataFrame, selection: Selection, stations: DataFrame | None = None) -> DataFrame:
    """Populated values against expected hours; repeats can exceed 100 %.

    Of a whole network every known station is expected, silent or not: those of the station
    dimension if it is given, else all that ever reported.
    """
    rows = filter_observations(facts, selection)
    if selection.stations is None:
        known = facts if stations is None else stations
        if selection.department is not None:
            known = known.where(F.col("department") == selection.department)
        none = F.lit(0).cast("bigint")
        expecting = known.select("NUM_POSTE").distinct().agg(F.count("*").alias("stations"))
        parts = expecting.withColumn("observations", none).unionByName(
            rows.agg(F.count("*").alias("observations")).withColumn("stations", none)
        )
        counted = parts.agg(F.sum("stations").alias("stations"), F.sum("observations").alias("observations"))
    else:
        counted = rows.agg(
            F.lit(len(selection.stations)).cast("bigint").alias("stations"),
            F.count("*").alias("observations"),
        )
    expected = selection_hours(selection) * F.col("stations")
    return counted.select(
        F.lit(f"{selection.start.isoformat()} – {selection.end.isoformat()}").alias("period"),
        "stations",
        "observations",
        expected.alias("expected"),
        values.percentage(F.col("observations"), expected).alias("coverage"),
    )


def daily_hour_counts(facts: DataFrame, selection: Selection) -> DataFrame:
    """Observation counts per station and day, one array slot per hour."""
    slots = [F.count(F.when(selection.hour == h, 1)) for h in HOURS]
    return (
        filter_observations(facts, selection)
        .groupBy("NUM_POSTE", selection.day.alias("observation_date"))
        .agg(F.array(*slots).alias("counts"))
    )


def _check_cells(selection: Selection, limit: int | None) -> None:
    days = (selection.end - selection.start).days + 1
    if limit is not None and days * len(HOURS) > limit:
        raise ResultTooLarge(f"{days} days are {days * len(HOURS):,} cells a station, more than the {limit:,} asked for")


def coverage_grid(facts: DataFrame, selection: Selection, limit: int | None = None) -> DataFrame:
    """Counts for every (date, hour) of a station, 0 where nothing was observed.

    Every observed day fills the gap up to the next one (the first also the gap before it), so a
    long period needs neither a list of a station's days nor a join with all dates.
    ``limit`` is a caller's bound on the cells of one station.
    """
    _check_cells(selection, limit)
    start, end = timeops.day_literal(selection.start), timeops.day_literal(selection.end)
    along = Window.partitionBy("NUM_POSTE").orderBy("observation_date")
    seen = daily_hour_counts(facts, selection).select(
        "NUM_POSTE",
        "observation_date",
        "counts",
        F.when(F.row_number().over(along) == 1, start).otherwise(F.col("observation_date")).alias("first"),
        F.coalesce(F.date_sub(F.lead("observation_date").over(along), 1), end).alias("last"),
    )
    days = seen.withColumn("day", F.explode(F.sequence("first", "last")))
    observed = F.when(F.col("day") == F.col("observation_date"), F.col("counts"))
    empty = F.array(*[F.lit(0).cast("bigint") for _ in HOURS])
    return days.select(
        "NUM_POSTE",
        F.col("day").alias("observation_date"),
        F.posexplode(F.coalesce(observed, empty)).alias("observation_hour", "observation_count"),
    )


def station_coverage_grid(facts: DataFrame, selection: Selection, limit: int | None = None) -> DataFrame:
    """Grid of the first selected station; all zero when it has no data at all."""
    if not selection.stations:
        raise ValueError("The grid of one station needs a selected station")
    first = replace(selection, stations=selection.stations[:1])
    _check_cells(first, limit)
    spark = facts.sparkSession
    dates = date_series(timeops.day_literal(first.start), timeops.day_literal(first.end))
    cells = spark.range(1).select(F.explode(dates).alias("observation_date")).select(
        "observation_date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("observation_hour")
    )
    counts = densify_coverage(cells, hourly_counts(facts, first))
    return counts.orderBy("observation_date", "observation_hour")


def hourly_counts(facts: DataFrame, selection: Selection) -> DataFrame:
    """Observations per date and hour (the fold hour counts twice)."""
    return (
        filter_observations(facts, selection)
        .groupBy(
            selection.day.alias("observation_date"),
            selection.hour.cast("int").alias("observation_hour"),
        )
        .agg(F.count("*").alias("observation_count"))
    )


def densify_coverage(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts on a scaffold of cells, 0 where there is none."""
    keys = [name for name in cells.columns if name in counts.columns]
    return cells.join(counts, keys, "left").withColumn(
        "observation_count", F.coalesce("observation_count", F.lit(0).cast("bigint"))
    )


def pivot_coverage(grid: DataFrame, selection: Selection) -> DataFrame:
    """One row per hour, one column per date (dates are known, so no extra pass)."""
    span = (selection.end - selection.start).days
    dates = [(selection.start + dt.timedelta(days=n)).isoformat() for n in range(span + 1)]
    day = F.date_format("observation_date", "yyyy-MM-dd").alias("day")
    return (
        grid.select("observation_hour", day, "observation_count")
        .groupBy("observation_hour")
        .pivot("day", dates)
        .agg(F.sum("observation_count"))
        .fillna(0)
    )


def station_map(facts: DataFrame, selection: Selection) -> DataFrame:
    """Latest attributes over the whole history with the period's coverage.

    One pass gives both: stations silent in the period keep zero counts.
    """
    rows = facts if selection.department is None else facts.where(
        F.col("department") == selection.department
    )
    ranges = attribute_ranges(rows, ["NUM_POSTE"], *period_counts(selection))
    stations = latest_attributes(
        ranges,
        ["NUM_POSTE"],
        F.sum("period_rows").alias("period_rows"),
        F.sum("metric_rows").alias("metric_rows"),
    )
    return stations.withColumns(
        {
            "coverage": values.capped_percentage(F.col("metric_rows"), selection_hours(selection)),
            "active_in_period": F.col("period_rows") > 0,
        }
    ).orderBy(F.asc_nulls_last("NOM_USUEL"), "NUM_POSTE")


def qualifying_days(
    facts: DataFrame, start: dt.date, end: dt.date, time_basis: str = "local",
    quality_mode: str = "all", minimum_daily_hours: int = DEFAULT_DAILY_HOURS,
) -> DataFrame:
    """Mean temperature of the station-days that have enough hours."""
    if start > end:
        raise ValueError("Start date must not be after end date")
    if not 1 <= minimum_daily_hours <= 25:
        raise ValueError("Minimum daily hours must be between 1 and 25")
    check_quality_mode(quality_mode)
    rows = facts.where(
        in_period(start, end, time_basis) & F.col("T").isNotNull() & quality_rule("T", quality_mode)
    )
    keys = ["department", "NUM_POSTE", "observation_date"]
    tuples = rows.withColumn("observation_date", timeops.day_of(time_basis)).groupBy(
        *keys, *ATTRIBUTES
    ).agg(
        F.sum("T").alias("total"),
        F.count("T").alias("hours"),
        F.max("observation_time_utc").alias("last_time"),
    )
    days = tuples.groupBy(*keys).agg(
        (F.sum("total") / F.sum("hours")).alias("daily_mean_temperature"),
        F.sum("hours").alias("valid_hours"),
        *[latest(name, "last_time").alias(name) for name in ATTRIBUTES],
        F.max("last_time").alias("latest_observation_utc"),
    )
    return days.where(F.col("valid_hours") >= minimum_daily_hours)


def temperature_overview(
    facts: DataFrame, start: dt.date, end: dt.date, time_basis: str = "local",
    quality_mode: str = "all", minimum_daily_hours: int = DEFAULT_DAILY_HOURS,
) -> DataFrame:
    """Mean of qualifying daily means per station: every day weighs the same."""
    days = qualifying_days(facts, start, end, time_basis, quality_mode, minimum_daily_hours)
    return (
        days.groupBy("department", "NUM_POSTE")
        .agg(
            *[latest(name, "latest_observation_utc").alias(name) for name in ATTRIBUTES],
            F.avg("daily_mean_temperature").alias("period_mean_temperature"),
            F.count("*").alias("qualifying_days"),
            F.sum("valid_hours").alias("valid_hours"),
            F.max("latest_observation_utc").alias("latest_observation_utc"),
        )
        .orderBy("department", F.asc_nulls_last("NOM_USUEL"), "NUM_POSTE")
    )

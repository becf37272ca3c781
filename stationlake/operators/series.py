"""Hourly and daily time series, and the historical comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions import timeops
from stationlake.operators.selection import (
    Selection,
    exclude_period,
    filter_observations,
    from_places,
    usable_values,
)
from stationlake.operators.stations import latest

INSTANT = "observation_time_utc"


def hourly_series(facts: DataFrame, selection: Selection) -> DataFrame:
    """Single values with their quality code, ordered by station and instant.

    Ordering uses the instant: in the autumn fold two instants share a wall clock.
    """
    return (
        filter_observations(facts, selection)
        .select(
            "NUM_POSTE",
            "NOM_USUEL",
            timeops.wall_clock_of(selection.time_basis).alias("observation_time"),
            selection.day.alias("observation_date"),
            selection.value.alias("value"),
            selection.quality.alias("quality_code"),
            F.lit(1).cast("bigint").alias("contributing_count"),
            F.lit("hourly").alias("statistic"),
            INSTANT,
        )
        .orderBy("NUM_POSTE", INSTANT)
        .drop(INSTANT)
    )


def station_days(rows: DataFrame, selection: Selection) -> DataFrame:
    """Count, sum, extremes and latest name per station and day.

    The first pass groups by name as well, so that its buffers hold numbers only
    and stay in a hash aggregation; the second merges the few renamed days.
    """
    value = selection.value
    per_name = rows.groupBy("NUM_POSTE", selection.day.alias("day"), "NOM_USUEL").agg(
        F.sum(value).alias("total"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.count(value).alias("hours"),
        F.max(INSTANT).alias("last_time"),
    )
    return per_name.groupBy("NUM_POSTE", "day").agg(
        latest("NOM_USUEL", "last_time").alias("NOM_USUEL"),
        F.max("last_time").alias("last_time"),
        F.sum("total").alias("total"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
        F.sum("hours").alias("hours"),
    )


def daily_statistics(facts: DataFrame, selection: Selection) -> DataFrame:
    """Requested statistics per station and day, one column each."""
    days = station_days(filter_observations(facts, selection), selection)
    forms = {
        "average": F.col("total") / F.col("hours"),
        "minimum": F.col("minimum"),
        "maximum": F.col("maximum"),
        "total": F.col("total"),
    }
    return days.select(
        "NUM_POSTE",
        "NOM_USUEL",
        F.col("day").alias("observation_date"),
        *[forms[name].alias(name) for name in selection.statistics],
        F.col("hours").alias("contributing_count"),
    )


def unpivot_statistics(daily: DataFrame, statistics: tuple[str, ...]) -> DataFrame:
    """One row per statistic."""
    keys = ["NUM_POSTE", "NOM_USUEL", "observation_date", "contributing_count"]
    return daily.unpivot(keys, list(statistics), "statistic", "value")


def daily_series(facts: DataFrame, selection: Selection) -> DataFrame:
    """Daily statistics in long form, ordered by station, date and statistic."""
    daily = daily_statistics(facts, selection)
    return unpivot_statistics(daily, selection.statistics).orderBy(
        "NUM_POSTE", "observation_date", "statistic"
    )


def historical_daily(facts: DataFrame, selection: Selection) -> DataFrame:
    """Station-day extremes (or totals, for rain) of the baseline."""
    rows = facts.where(from_places(selection) & usable_values(selection))
    if selection.baseline_excludes_selection:
        rows = rows.where(exclude_period(selection))
    value = selection.value
    columns = (
        [F.sum(value).alias("daily_total")]
        if selection.metric == "RR1"
        else [F.min(value).alias("daily_minimum"), F.max(value).alias("daily_maximum")]
    )
    return rows.groupBy("NUM_POSTE", selection.day.alias("historical_date")).agg(*columns)


def _envelope(metric: str, low: str, high: str, total: str, keep: Column) -> list[Column]:
    """Envelope aggregates over station-days for which ``keep`` holds.

    A station has one row per day, so the days of one calendar day all lie in
    different years: counting them counts the years, without a distinct count.
    """

    def on(column: str) -> Column:
        return F.when(keep, F.col(column))

    nothing = F.lit(None).cast("double")
    if metric == "RR1":
        shape = [F.min(on(total)), F.max(on(total)), nothing, nothing, F.avg(on(total))]
    else:
        shape = [F.min(on(low)), F.max(on(high)), F.avg(on(low)), F.avg(on(high)), nothing]
    names = (
        "absolute_minimum", "absolute_maximum", "average_minimum", "average_maximum",
        "historical_average_total",
    )
    days = F.count(F.when(keep, 1))
    return [
        *[column.alias(name) for column, name in zip(shape, names)],
        days.alias("historical_days"),
        days.alias("historical_years"),
    ]


def historical_envelope(daily: DataFrame, metric: str) -> DataFrame:
    """Extremes and means of the baseline per station and calendar day."""
    aggregates = _envelope(
        metric, "daily_minimum", "daily_maximum", "daily_total", F.lit(True)
    )
    key = timeops.month_day(F.col("historical_date")).alias("month_day")
    return daily.groupBy("NUM_POSTE", key).agg(*aggregates)


def date_series(start: Column, end: Column) -> Column:
    """Every day of an inclusive range, as an array."""
    return F.sequence(start, end, F.expr("INTERVAL 1 DAY"))


def stations_by_dates(stations: DataFrame, selection: Selection) -> DataFrame:
    """Every station on every selected date (generated per row, no join)."""
    dates = date_series(timeops.day_literal(selection.start), timeops.day_literal(selection.end))
    return stations.withColumn("observation_date", F.explode(dates))


def join_selected_days(scaffold: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected daily values on the scaffold; days without data stay."""
    return scaffold.join(selected, ["NUM_POSTE", "observation_date"], "left")


def join_baseline(scaffold: DataFrame, envelope: DataFrame) -> DataFrame:
    """Baseline of the calendar day of each scaffold date."""
    keyed = scaffold.withColumn("month_day", timeops.month_day(F.col("observation_date")))
    return keyed.join(envelope, ["NUM_POSTE", "month_day"], "left")


def historical_comparison(facts: DataFrame, selection: Selection) -> DataFrame:
    """Selected daily values next to the station's baseline for the calendar day.

    The history is read once.  It shrinks to station-days, then to one row per
    station and calendar day that carries the baseline and the selected days
    falling on it (one per selected year), then to one row per station with at
    most 366 of those entries, which is spread over the selected dates.
    """
    rows = facts.where(from_places(selection) & usable_values(selection))
    day = F.col("day")
    start, end = timeops.day_literal(selection.start), timeops.day_literal(selection.end)
    inside = day.between(start, end)
    keep = ~inside if selection.baseline_excludes_selection else F.lit(True)
    rain = selection.metric == "RR1"
    nothing = F.lit(None).cast("double")
    picked = F.struct(
        day.alias("day"),
        (F.col("total") if rain else nothing).alias("selected_total"),
        (nothing if rain else F.col("total") / F.col("hours")).alias("selected_average"),
        (nothing if rain else F.col("minimum").cast("double")).alias("selected_minimum"),
        (nothing if rain else F.col("maximum").cast("double")).alias("selected_maximum"),
        F.col("hours").alias("selected_contributing_hours"),
    )
    calendar = (
        station_days(rows, selection)
        .groupBy("NUM_POSTE", timeops.month_day(day).alias("month_day"))
        .agg(
            *_envelope(selection.metric, "minimum", "maximum", "total", keep),
            F.collect_list(F.when(inside, picked)).alias("selected_days"),
            latest("NOM_USUEL", "last_time").alias("name"),
            F.max("last_time").alias("last_time"),
        )
    )
    baseline = (
        "absolute_minimum", "absolute_maximum", "average_minimum", "average_maximum",
        "historical_average_total", "historical_days", "historical_years",
    )
    entry = F.struct("month_day", F.struct(*baseline, "selected_days").alias("entry"))
    stations = calendar.groupBy("NUM_POSTE").agg(
        latest("name", "last_time").alias("NOM_USUEL"),
        F.map_from_entries(F.collect_list(entry)).alias("calendar"),
    )
    spread = stations_by_dates(stations, selection).select(
        "NUM_POSTE",
        "NOM_USUEL",
        "observation_date",
        F.try_element_at("calendar", timeops.month_day(F.col("observation_date"))).alias("entry"),
    )
    spread = spread.withColumn(
        "selected",
        F.get(F.filter("entry.selected_days", lambda d: d["day"] == F.col("observation_date")), F.lit(0)),
    )
    # A calendar day seen only inside the selection has no baseline at all.
    has_baseline = F.col("entry.historical_days") > 0
    chosen = (
        "selected_total", "selected_average", "selected_minimum", "selected_maximum",
        "selected_contributing_hours",
    )
    return spread.select(
        "NUM_POSTE",
        "NOM_USUEL",
        "observation_date",
        *[F.col(f"selected.{name}").alias(name) for name in chosen],
        *[F.when(has_baseline, F.col(f"entry.{name}")).alias(name) for name in baseline],
        F.lit(selection.baseline_excludes_selection).alias("baseline_excludes_selected_period"),
    ).orderBy("NUM_POSTE", "observation_date")

"""Text rows of archives to typed facts, with the rules a publication must meet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions import timeops, values
from stationlake.schema import (
    COMMON_FIELDS,
    EXTENSION_TABLES,
    IDENTITY_COLUMNS,
    KNOWN_CODE_COLUMNS,
    NETWORK_CATEGORY,
    SPARK_TYPES,
    TABLE_METRICS,
    UNSIGNED_LIMITS,
    source_type,
    table_columns,
)


def source_column(rows: DataFrame, name: str) -> Column:
    """A source column, or NULL text when no archive has it."""
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def common_columns(run_id: str) -> list[Column]:
    """Identity, time and lineage columns shared by all fact tables."""
    instant = timeops.parse_observation_time(F.col("AAAAMMJJHH"))
    altitude = values.parse_number(F.col("ALTI"))
    forms = {
        "department": F.col("department"),
        "network_category": F.lit(NETWORK_CATEGORY),
        "LAT": values.parse_number(F.col("LAT")),
        "LON": values.parse_number(F.col("LON")),
        "ALTI": F.when(altitude >= 0, F.floor(altitude)).otherwise(F.ceil(altitude)),
        "observation_time_utc": instant,
        "observation_time_local": timeops.local_wall_clock(instant),
        "local_date": timeops.local_date(instant),
        "local_hour": timeops.local_hour(instant),
        "utc_offset_minutes": timeops.utc_offset_minutes(instant),
        "is_dst": timeops.is_dst(instant),
        "processing_run_id": F.lit(run_id),
    }
    return [
        forms.get(field.name, F.col(field.name)).cast(field.dataType).alias(field.name)
        for field in COMMON_FIELDS
    ]


def utc_year() -> Column:
    return F.year(timeops.parse_observation_time(F.col("AAAAMMJJHH")))


def has_payload(rows: DataFrame, table: str) -> Column:
    """Whether any base metric of a table is filled (quality codes do not count)."""
    filled = F.lit(False)
    for name in TABLE_METRICS[table]:
        if name in rows.columns:
            filled = filled | values.is_populated(F.col(name))
    return filled


def typed_facts(rows: DataFrame, table: str, run_id: str) -> DataFrame:
    """Rows of one fact table: every row for the core, filled rows for an extension."""
    chosen = rows if table == "hourly_core" else rows.where(has_payload(rows, table))
    metrics = [
        values.convert_metric(source_column(rows, name), name).alias(name)
        if name in rows.columns
        else F.lit(None).cast(SPARK_TYPES[source_type(name)]).alias(name)
        for name in table_columns(table)
    ]
    return chosen.select(*common_columns(run_id), *metrics, utc_year().alias("year"))


def rows_of_years(rows: DataFrame, years: Iterable[int]) -> DataFrame:
    """Rows whose UTC year is affected."""
    return rows.where(utc_year().isin(sorted(years)))


def files_of_years(archives: DataFrame, years: Iterable[int]) -> DataFrame:
    """Archives whose period contains an affected year."""
    wanted = F.array(*[F.lit(year) for year in sorted(years)])
    return archives.where(F.arrays_overlap(F.sequence("period_start", "period_end"), wanted))


def _metric_columns(rows: DataFrame) -> list[str]:
    return [c for table in TABLE_METRICS for c in table_columns(table) if c in rows.columns]


def _is_bad(value: Column, limit: Column | None) -> Column:
    """Populated text that is no number or, with a limit, no whole number up to it."""
    number = values.parse_number(value)
    if limit is None:
        return (value != "") & number.isNull()
    whole = number.try_cast("int")
    return (value != "") & (whole.isNull() | (whole < 0) | (whole > limit))


def _any_bad(texts: Column, limit: Column | None) -> Column:
    return F.exists(texts, lambda value: _is_bad(value, limit))


def has_bad_metric(rows: DataFrame) -> Column:
    """Whether any metric of a row fails to convert.

    One array per type keeps the plan small: a condition per column would make
    generated code for the near two hundred columns too large to compile.
    """
    found = F.lit(False)
    for kind in SPARK_TYPES:
        names = [F.col(c) for c in _metric_columns(rows) if source_type(c) == kind]
        limit = F.lit(UNSIGNED_LIMITS[kind]) if kind in UNSIGNED_LIMITS else None
        if names:
            found = found | F.coalesce(_any_bad(F.array(*names), limit), F.lit(False))
    return found


def first_bad_metric(rows: DataFrame) -> Column:
    """``invalid NAME=value`` of the first metric that fails to convert."""
    names = _metric_columns(rows)
    if not names:
        return F.lit(None).cast("string")
    no_limit = -1
    limits = [UNSIGNED_LIMITS.get(source_type(c), no_limit) for c in names]
    entries = F.arrays_zip(
        F.lit(names).alias("name"),
        F.array(*[F.col(c) for c in names]).alias("value"),
        F.lit(limits).alias("limit"),
    )

    def broken(entry: Column) -> Column:
        value, limit = entry["value"], entry["limit"]
        return F.when(limit == no_limit, _is_bad(value, None)).otherwise(_is_bad(value, limit))

    first = F.get(F.filter(entries, broken), F.lit(0))
    return F.concat(F.lit("invalid "), first["name"], F.lit("="), first["value"])


# Degrees, and metres that fit the column of the altitude.
PLACE_LIMITS = {"LAT": 90.0, "LON": 180.0, "ALTI": 2.0**31 - 1}


def _row_rules(rows: DataFrame) -> list[tuple[Column, Column]]:
    """Layout, identity and time rules as (violated, reason) pairs, in order."""
    rules = [(F.col("is_malformed"), F.lit("wrong number of fields"))]
    for name in IDENTITY_COLUMNS:
        rules.append((~values.is_populated(source_column(rows, name)), F.lit(f"missing required {name}")))
    raw = F.col("AAAAMMJJHH")
    rules.append((~timeops.is_valid_time(raw), F.concat(F.lit("invalid AAAAMMJJHH="), raw)))
    for name, most in PLACE_LIMITS.items():
        value = F.col(name)
        inside = values.parse_number(value).between(-most, most)
        rules.append((~F.coalesce(inside, F.lit(False)), F.concat(F.lit(f"invalid {name}="), value)))
    return rules


def row_problems(rows: DataFrame, years: Iterable[int] | None = None) -> DataFrame:
    """Rows that break a rule, with the first reason.

    Layout, identity and time are checked on every row, metric values only in
    the affected years.  Reasons are worded for the flagged rows alone.
    """
    rules = _row_rules(rows)
    violated = F.lit(False)
    for broken, _ in rules:
        violated = violated | broken
    affected = F.lit(True) if years is None else utc_year().isin(sorted(years))
    flagged = rows.where(violated | (affected & has_bad_metric(rows)))
    reason = F.when(*rules[0])
    for rule in rules[1:]:
        reason = reason.when(*rule)
    reason = reason.otherwise(first_bad_metric(rows))
    return flagged.select("source_file", "source_row_number", reason.alias("problem"))


def first_problem(rows: DataFrame, years: Iterable[int] | None = None) -> str | None:
    """``file:row: reason`` of the first violation in file order, if any."""
    found = row_problems(rows, years).orderBy("source_file", "source_row_number").take(1)
    if not found:
        return None
    return f"{found[0].source_file}:{found[0].source_row_number}: {found[0].problem}"


def ingestion_counts(rows: DataFrame) -> DataFrame:
    """Source, core and extension row counts of the rows to publish, in one pass."""
    return rows.agg(
        F.count("*").alias("source_rows"),
        F.count("*").alias("core_rows"),
        *[F.count_if(has_payload(rows, table)).alias(table) for table in EXTENSION_TABLES],
    )


def unknown_code_columns(headers: DataFrame) -> DataFrame:
    """Quality-like columns per archive that the fixed schema does not hold."""
    return headers.select(
        "filename",
        values.unknown_code_columns(F.col("columns"), KNOWN_CODE_COLUMNS).alias("unknown_quality_columns"),
    )

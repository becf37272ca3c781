"""Report jobs over raw archives: schema, inventory, profile, exploration."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.values import schema_fingerprint
from stationlake.operators import profiling
from stationlake.session import configure, shared_folder
from stationlake.sinks.reports import report_provenance, write_report
from stationlake.sources import archives as raw
from stationlake.sources.dictionary import read_dictionary
from stationlake.sources.files import delete

MODES = ("schema", "inventory", "profile")


def _headers(spark: SparkSession, listed: DataFrame, folder: str) -> DataFrame:
    """Probed headers as a stored table, where nothing else of the archives is needed."""
    raw.probe_headers(listed).write.mode("overwrite").parquet(f"{folder}/headers")
    return spark.read.parquet(f"{folder}/headers")


def report_headers(headers: DataFrame) -> DataFrame:
    """Probed headers under the names the reports use."""
    return headers.withColumnsRenamed({"filename": "source_file", "size": "compressed_size"})


def inventory_report(headers: DataFrame, counts: DataFrame | None) -> DataFrame:
    """One row per archive; count columns stay NULL where rows were not read."""
    named = report_headers(headers).select(
        F.col("source_file").alias("filename"), "department", "period_start", "period_end",
        "compressed_size", F.col("mtime_ns").alias("modified_ns"), "encoding", "delimiter",
        F.when(F.col("columns").isNotNull(), schema_fingerprint(F.col("columns"))).alias("schema_id"),
        F.when(F.col("columns").isNotNull(), F.size("columns")).alias("column_count"),
        "inspection_error",
    )
    if counts is None:
        return named.withColumns(
            {
                **{n: F.lit(None).cast("bigint") for n in ("row_count", "station_count")},
                **{n: F.lit(None).cast("string") for n in ("earliest_timestamp", "latest_timestamp")},
                **{n: F.lit(0).cast("bigint") for n in ("malformed_rows", "invalid_timestamps")},
            }
        )
    counted = counts.drop("period_start", "period_end").withColumnRenamed("source_file", "filename")
    joined = named.join(counted, "filename", "left")
    # A readable archive with nothing below its header has zero rows.
    readable = F.col("inspection_error").isNull()
    for name in ("row_count", "station_count", "malformed_rows", "invalid_timestamps"):
        joined = joined.withColumn(name, F.when(readable, F.coalesce(name, F.lit(0))).otherwise(F.col(name)))
    return joined


def inspect_archives(
    spark: SparkSession, root: str, report_folder: str, mode: str = "inventory",
    departments: Iterable[str] | None = None, start_year: int | None = None,
    end_year: int | None = None, dictionary_path: str | None = None,
) -> dict:
    """Write the reports of a mode; returns the numbers of archives, schemas and errors."""
    if mode not in MODES:
        raise ValueError(f"Unknown inspection mode: {mode}")
    configure(spark)
    folder = shared_folder(spark, "inspect")
    try:
        listed = raw.discover_archives(spark, root, departments, start_year, end_year)
        if mode == "schema":
            headers, records = _headers(spark, listed, folder), None
        else:
            headers, records = raw.read_archives(spark, listed, folder)
        named = report_headers(headers)
        selected = headers.count()
        provenance = report_provenance(
            mode, root, selected,
            {"departments": sorted(departments) if departments else None,
             "start_year": start_year, "end_year": end_year},
        )
        readable = named.where(F.col("columns").isNotNull())
        has_rows = bool(readable.take(1))
        rows = None
        if records is not None and has_rows:
            rows = raw.parse_records(spark, records, headers, f"{folder}/rows")
        counts = profiling.archive_inventory(rows, readable) if rows is not None else None
        write_report(inventory_report(headers, counts), report_folder, "archive_inventory", provenance)
        groups = profiling.schema_groups(readable)
        write_report(groups, report_folder, "schemas", provenance)
        coverage = profiling.column_coverage(readable)
        write_report(coverage, report_folder, "column_coverage", provenance)
        official = (
            read_dictionary(spark, dictionary_path)
            if dictionary_path
            else spark.createDataFrame([], "name string, description string")
        )
        dictionary = profiling.column_dictionary(coverage, official, F.lit(selected))
        write_report(dictionary, report_folder, "column_dictionary", provenance)
        if mode == "profile" and rows is not None:
            examples = groups.select(F.col("representative_file").alias("source_file"))
            profile = profiling.archive_profile(rows.join(examples, "source_file", "left_semi"))
            own = readable.select(
                F.col("source_file").alias("filename"), F.explode("columns").alias("column")
            )
            # Staged rows carry the columns of all layouts; a file reports its own.
            write_report(
                profile.join(own, ["filename", "column"], "left_semi"), report_folder,
                "profile_summary", provenance,
            )
        errors = headers.where("inspection_error is not null").count()
        return {"selected": selected, "schemas": groups.count(), "errors": errors}
    finally:
        delete(spark, folder)


def explore_department(
    spark: SparkSession, root: str, report_folder: str, department: str,
    start_year: int | None = None, end_year: int | None = None,
) -> dict:
    """All row-level reports of one department; returns the headline counts."""
    configure(spark)
    folder = shared_folder(spark, "explore")
    try:
        listed = raw.discover_archives(spark, root, {department}, start_year, end_year)
        if not listed.take(1):
            return {"archives": 0, "stations": 0, "errors": 1}
        headers, records = raw.read_archives(spark, listed, folder)
        readable = report_headers(headers).where(F.col("columns").isNotNull())
        rows = raw.parse_records(spark, records, headers, f"{folder}/rows")
        reports = exploration_reports(rows, readable)
        counts = reports.pop("archive_inventory")
        reports = {"archive_inventory": inventory_report(headers, counts), **reports}
        provenance = {
            "department": department, "archive_count": headers.count(),
            "timestamp_convention": "UTC (metropolitan France)",
        }
        stored = {
            name: spark.read.parquet(write_report(frame, report_folder, name, provenance))
            for name, frame in reports.items()
        }
        overlaps = profiling.archive_overlaps(stored["duplicate_observations"])
        write_report(overlaps, report_folder, "archive_overlaps", provenance)
        summary = profiling.exploration_summary(
            stored["archive_inventory"], stored["station_inventory"],
            stored["duplicate_observations"], stored["station_year_temperature_coverage"],
            stored["station_metadata_conflicts"],
        )
        return summary.first().asDict()
    finally:
        delete(spark, folder)


def exploration_reports(rows: DataFrame, headers: DataFrame | None = None) -> dict[str, DataFrame]:
    """The reports of an exploration over staged rows."""
    sets = profiling.station_value_sets(rows)
    return {
        "archive_inventory": profiling.archive_inventory(rows, headers, stations_need_time=True),
        "station_inventory": profiling.station_inventory(sets),
        "station_metadata_conflicts": profiling.metadata_conflicts(sets),
        "column_profile": profiling.column_profile(rows, headers),
        "quality_code_profile": profiling.quality_code_profile(rows),
        "station_year_temperature_coverage": profiling.station_year_coverage(rows),
        "duplicate_observations": profiling.duplicate_observations(rows),
    }

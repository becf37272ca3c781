"""Bringing one department's published tables in line with its archives."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from stationlake.operators import audits, ingest, stations
from stationlake.operators.metrics import metric_dimension
from stationlake.schema import (
    DATASET_VERSION,
    EXTENSION_TABLES,
    IDENTITY_COLUMNS,
    NETWORK_CATEGORY,
    SOURCE_FILE_SCHEMA,
    TABLE_METRICS,
    TRANSFORMATION_VERSION,
)
from stationlake.session import configure, shared_folder, stored
from stationlake.sinks import tables
from stationlake.sources import archives as raw
from stationlake.sources.dictionary import read_dictionary
from stationlake.sources.facts import RUN_SCHEMA, read_table
from stationlake.sources.files import delete
from stationlake.sources.manifests import RECORD_FIELDS, read_manifests, source_records, validated_manifests

MANIFEST_FIELDS = (
    "dataset_version int, transformation_version string, department string, "
    "network_category string, updated_at string, processing_run_id string, "
    "source_files map<string, struct<filename: string, department: string, period_start: bigint, "
    "period_end: bigint, size: bigint, mtime_ns: bigint, sha256: string>>, "
    "materialized_years array<int>, "
    "counts struct<source_rows: bigint, core_rows: bigint, extension_rows: map<string, bigint>>"
)


EMPTY_ROWS = (
    "source_file string, source_row_number bigint, is_malformed boolean, "
    + ", ".join(f"{name} string" for name in IDENTITY_COLUMNS)
    + ", department string, period_start int, period_end int, source_sha256 string"
)


def metropolitan_code(department: str) -> str:
    """Normalised code, or an error for departments with other time rules."""
    code = department.upper()
    if code in ("2A", "2B") or (code.isdigit() and 1 <= int(code) <= 95):
        return code
    raise ValueError(f"Dataset v1 supports metropolitan departments only: {code}")


@dataclass(frozen=True)
class SyncPlan:
    """What has to be done; lists name files and years, never observations."""

    department: str
    sources: tuple[Row, ...]
    changed_files: tuple[str, ...]
    removed_files: tuple[str, ...]
    years: tuple[int, ...]
    rebuild_required: bool
    no_op: bool


@dataclass
class SyncResult:
    status: str
    plan: SyncPlan
    run_id: str | None = None
    counts: dict = field(default_factory=dict)
    error: str | None = None


def _source_frame(spark: SparkSession, rows) -> DataFrame:
    names = SOURCE_FILE_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(row[n] for n in names) for row in rows], SOURCE_FILE_SCHEMA)


def plan_sync(
    spark: SparkSession, raw_root: str, analytics_root: str, department: str, rebuild: bool = False
) -> SyncPlan:
    """Compare the archives of a department with its manifest."""
    configure(spark)
    code = metropolitan_code(department)
    manifest = read_manifests(spark, analytics_root).where(F.col("path_department") == code)
    known = manifest.select("dataset_version", "transformation_version").take(1)
    previous = source_records(manifest)
    listed = raw.discover_archives(spark, raw_root, {code})
    sources = raw.fingerprint_archives(listed, previous).orderBy("filename").collect()
    if not sources:
        raise ValueError(f"No verified local hourly archives found for department {code}")
    changes = audits.diff_sources(_source_frame(spark, sources), previous).collect()
    touched = [c for c in changes if c.change != "unchanged"]
    periods = sources if rebuild or not known else touched
    outdated = bool(known) and (
        known[0].dataset_version != DATASET_VERSION
        or known[0].transformation_version != TRANSFORMATION_VERSION
    )
    return SyncPlan(
        department=code,
        sources=tuple(sources),
        changed_files=tuple(sorted(c.filename for c in touched if c.change != "removed")),
        removed_files=tuple(sorted(c.filename for c in touched if c.change == "removed")),
        years=tuple(sorted({y for p in periods for y in range(p.period_start, p.period_end + 1)})),
        rebuild_required=outdated,
        no_op=bool(known) and not rebuild and not touched and not outdated,
    )


def stage_sources(spark: SparkSession, plan: SyncPlan, folder: str) -> DataFrame:
    """Text rows of the archives that overlap the affected years, with their digests."""
    paths = {row.filename: row.path for row in plan.sources}
    wanted = ingest.files_of_years(_source_frame(spark, plan.sources), plan.years).select("filename")
    chosen = {row.filename for row in wanted.collect()}
    if not chosen:
        # Only removals: the affected years end up empty.
        return spark.createDataFrame([], EMPTY_ROWS)
    listed = spark.createDataFrame(
        [
            (paths[s.filename], s.filename, s.department, s.period_start, s.period_end, s.size, s.mtime_ns)
            for s in plan.sources
            if s.filename in chosen
        ],
        raw.ARCHIVE_SCHEMA,
    )
    headers, records = raw.read_archives(spark, listed, folder)
    needed = F.array(*[F.lit(name) for name in IDENTITY_COLUMNS])
    reason = F.coalesce(
        "inspection_error",
        F.when(
            F.size(F.array_except(needed, "columns")) > 0,
            F.concat(F.lit("missing required columns "), F.array_join(F.array_except(needed, "columns"), ", ")),
        ),
    )
    failed = headers.select("filename", reason.alias("reason")).where("reason is not null")
    first = failed.orderBy("filename").take(1)
    if first:
        raise ValueError(f"{first[0].filename}: {first[0].reason}")
    rows = raw.parse_records(spark, records, headers, f"{folder}/rows")
    digests = _source_frame(spark, plan.sources).select(
        F.col("filename").alias("source_file"), F.col("sha256").alias("source_sha256")
    )
    # One row per archive; a shuffle would gather all rows of an archive in one task.
    return rows.join(F.broadcast(digests), "source_file")


def stage_tables(rows: DataFrame, plan: SyncPlan, run_id: str, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """Facts of the affected years written aside, and counts that all agree; or an error before anything is published.

    What the archives hold, what each write counted while it wrote, and what is found in the staged files must be
    the same, and no station-hour may be there twice.
    """
    problem = ingest.first_problem(rows, plan.years)
    if problem:
        raise ValueError(problem)
    affected = ingest.rows_of_years(rows, plan.years)
    counted = ingest.ingestion_counts(affected).first()
    staged, problems = {}, []
    for table in TABLE_METRICS:
        staged[table], written = tables.stage_facts(ingest.typed_facts(affected, table, run_id), folder, table)
        found = staged[table].count()
        expected = counted.core_rows if table == "hourly_core" else counted[table]
        if not expected == written == found:
            problems.append(f"{table}: source={expected}, written={written}, stored={found}")
    if counted.source_rows != counted.core_rows or problems:
        raise ValueError("Row reconciliation failed: " + "; ".join(problems or [f"source={counted.source_rows}, core={counted.core_rows}"]))
    repeated = audits.duplicate_station_hours(staged["hourly_core"]).count()
    if repeated:
        raise ValueError(f"Duplicate station-hour keys: {repeated}")
    return staged, {
        "source_rows": counted.source_rows,
        "core_rows": counted.core_rows,
        "extension_rows": {table: counted[table] for table in EXTENSION_TABLES},
    }


def write_metadata(spark: SparkSession, root: str) -> tuple[int, int]:
    """Departments and source files, rebuilt from the manifests."""
    manifests = validated_manifests(spark, root)
    departments = audits.department_rows(manifests.select("department"))
    records = audits.source_file_rows(source_records(manifests))
    tables.write_small_table(departments, root, "departments", ["department"])
    tables.write_small_table(records, root, "source_files", ["department", "filename"])
    return departments.count(), records.count()


def _manifest_frame(spark: SparkSession, plan: SyncPlan, run_id: str, years: list[int], counts: dict) -> DataFrame:
    files = {s.filename: tuple(s[n] for n in RECORD_FIELDS) for s in plan.sources}
    now = dt.datetime.now(dt.timezone.utc).isoformat()
    record = (
        DATASET_VERSION, TRANSFORMATION_VERSION, plan.department, NETWORK_CATEGORY, now, run_id,
        files, years, (counts["source_rows"], counts["core_rows"], counts["extension_rows"]),
    )
    return spark.createDataFrame([record], MANIFEST_FIELDS)


def publish(spark: SparkSession, root: str, plan: SyncPlan, folder: str) -> None:
    """Move the staged facts of the affected years into place, then write the station tables."""
    for table in TABLE_METRICS:
        tables.publish_partitions(spark, folder, root, table, plan.department, list(plan.years))
    # A department whose last archive was removed leaves no facts.
    core = read_table(spark, root, "hourly_core", may_be_empty=True).where(F.col("department") == plan.department)
    ranges = stored(stations.station_ranges(core), "station-ranges", folder)
    tables.write_station_dimension(stations.dimension_of(ranges), root, "stations", plan.department)
    tables.write_station_dimension(
        stations.history_of(ranges), root, "station_metadata_history", plan.department
    )


def sync_department(
    spark: SparkSession, raw_root: str, analytics_root: str, dictionary_path: str,
    department: str, rebuild: bool = False,
) -> SyncResult:
    """Publish a department's changed years; nothing is published unless all rows pass.

    The manifest comes last, so an interrupted run is simply repeated.  Plain
    Parquet folders give no atomic change of several tables, and none is claimed.
    """
    plan = plan_sync(spark, raw_root, analytics_root, department, rebuild)
    if plan.rebuild_required and not rebuild:
        return SyncResult("schema-rebuild-required", plan)
    if plan.no_op:
        return SyncResult("up-to-date", plan)
    run_id = str(uuid.uuid4())
    started = dt.datetime.now(dt.timezone.utc)
    folder = shared_folder(spark, "sync")
    try:
        rows = stage_sources(spark, plan, folder)
        _, counts = stage_tables(rows, plan, run_id, folder)
        publish(spark, analytics_root, plan, folder)
        metrics = metric_dimension(spark, read_dictionary(spark, dictionary_path))
        tables.write_small_table(metrics, analytics_root, "metrics", ["owning_table", "source_mnemonic"])
        years = tables.materialized_years(spark, analytics_root, plan.department)
        tables.write_manifest(
            _manifest_frame(spark, plan, run_id, years, counts), analytics_root, plan.department
        )
        write_metadata(spark, analytics_root)
        finished = dt.datetime.now(dt.timezone.utc)
        run = spark.createDataFrame(
            [
                (
                    run_id, plan.department, DATASET_VERSION, TRANSFORMATION_VERSION, started, finished,
                    "success", json.dumps(plan.changed_files), json.dumps(plan.years),
                    counts["source_rows"], counts["core_rows"],
                )
            ],
            RUN_SCHEMA,
        )
        tables.append_run(run, analytics_root)
        return SyncResult("synchronized", plan, run_id, counts)
    except Exception as error:
        # Every failure leaves a record; errors of the engine are raised again after it.
        report = spark.createDataFrame(
            [(run_id, plan.department, started, type(error).__name__, str(error), list(plan.years))],
            "processing_run_id string, department string, started_at timestamp, error_type string, "
            "error string, affected_years array<int>",
        ).withColumn("failed_at", F.current_timestamp())
        tables.write_failure(report, analytics_root, run_id)
        if not isinstance(error, ValueError):
            raise
        return SyncResult("failed", plan, run_id, error=str(error))
    finally:
        delete(spark, folder)

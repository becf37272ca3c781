"""Stored tables of an analytics folder as DataFrames and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stationlake.schema import SOURCE_FILE_SCHEMA, TABLE_METRICS, fact_schema
from stationlake.sources.files import exists, has_data

STATION_SCHEMA = (
    "network_category string, NUM_POSTE string, NOM_USUEL string, LAT double, LON double, ALTI int, "
    "first_observation_utc timestamp, last_observation_utc timestamp, "
    "source_departments array<string>, name_variant_count bigint, location_variant_count bigint, "
    "department string"
)
HISTORY_SCHEMA = (
    "network_category string, NUM_POSTE string, NOM_USUEL string, LAT double, LON double, ALTI int, "
    "first_observation_utc timestamp, last_observation_utc timestamp, department string"
)
DEPARTMENT_SCHEMA = (
    "department string, department_name string, source_time_convention string, "
    "analytical_timezone string, geography_class string"
)
SOURCE_FILES_SCHEMA = (
    "filename string, department string, period_start bigint, period_end bigint, size bigint, "
    "mtime_ns bigint, sha256 string, network_category string"
)
METRIC_SCHEMA = (
    "source_mnemonic string, quality_mnemonic string, quality_for string, category string, "
    "owning_table string, physical_type string, official_description_fr string, "
    "official_unit_text string, english_label string, english_description string, "
    "english_text_curated boolean, categorical boolean, documentation_source string, "
    "schema_version int"
)
RUN_SCHEMA = (
    "processing_run_id string, department string, dataset_version int, transformation_version string, "
    "started_at timestamp, finished_at timestamp, status string, changed_files string, "
    "affected_years string, source_rows bigint, core_rows bigint"
)

TABLE_PATHS = {
    "hourly_core": "facts/hourly_core",
    "hourly_surface": "extensions/hourly_surface",
    "hourly_marine": "extensions/hourly_marine",
    "hourly_snow": "extensions/hourly_snow",
    "stations": "dimensions/stations",
    "station_metadata_history": "dimensions/station_metadata_history",
    "metrics": "dimensions/metrics",
    "departments": "dimensions/departments",
    "source_files": "metadata/source_files",
    "processing_runs": "metadata/processing_runs",
}
TABLE_SCHEMAS = {
    **{table: fact_schema(table) for table in TABLE_METRICS},
    "stations": STATION_SCHEMA,
    "station_metadata_history": HISTORY_SCHEMA,
    "metrics": METRIC_SCHEMA,
    "departments": DEPARTMENT_SCHEMA,
    "source_files": SOURCE_FILES_SCHEMA,
    "processing_runs": RUN_SCHEMA,
}
__all__ = ["SOURCE_FILE_SCHEMA", "TABLE_PATHS", "TABLE_SCHEMAS", "read_table", "register_views", "table_path"]


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{TABLE_PATHS[table]}"


def read_table(spark: SparkSession, root: str, table: str, may_be_empty: bool | None = None) -> DataFrame:
    """A stored table with its declared schema.

    Declaring the schema keeps department codes text, needs no footer reads, and gives columns that
    older files lack as NULL.  A root that does not exist is an error, and so are missing core facts (unless
    ``may_be_empty``); extensions and metadata that were never written have no rows.
    """
    path = table_path(root, table)
    if not has_data(spark, path):
        if not exists(spark, root):
            raise FileNotFoundError(f"There is no dataset at {root}")
        if not (table != "hourly_core" if may_be_empty is None else may_be_empty):
            raise FileNotFoundError(f"The dataset at {root} has no {table}")
        return spark.createDataFrame([], TABLE_SCHEMAS[table])
    return spark.read.schema(TABLE_SCHEMAS[table]).parquet(path)


def register_views(spark: SparkSession, root: str) -> list[str]:
    """A temporary view per table."""
    for table in TABLE_PATHS:
        read_table(spark, root, table).createOrReplaceTempView(table)
    return list(TABLE_PATHS)

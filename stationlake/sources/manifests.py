"""Department manifests: what was materialised, from which source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions import values
from stationlake.sources.files import has_data

RECORD = (
    "filename: string, department: string, period_start: bigint, period_end: bigint, "
    "size: bigint, mtime_ns: bigint, sha256: string"
)
RECORD_FIELDS = (
    "filename", "department", "period_start", "period_end", "size", "mtime_ns", "sha256",
)
MANIFEST_SCHEMA = (
    "dataset_version int, transformation_version string, department string, "
    "network_category string, updated_at string, processing_run_id string, "
    f"source_files map<string, struct<{RECORD}>>, materialized_years array<int>, "
    "counts struct<source_rows: bigint, core_rows: bigint, extension_rows: map<string, bigint>>, "
    "corrupt string"
)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests below ``root``/manifests, with the department their path names."""
    path = f"{root.rstrip('/')}/manifests"
    if not has_data(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA + ", path_department string")
    rows = (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt")
        .option("recursiveFileLookup", True)
        .json(path)
    )
    named = F.upper(F.regexp_extract("_metadata.file_path", r"department=([0-9A-Za-z]+)", 1))
    return rows.withColumn("path_department", named)


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """Violated rules per manifest and source record."""
    own = F.col("path_department")
    whole = (
        F.when(F.col("corrupt").isNotNull(), "invalid JSON")
        .when(F.upper(F.coalesce("department", F.lit(""))) != own, "manifest department mismatch")
        .when(~values.is_metropolitan(own), "unsupported manifest department")
        .when(F.col("source_files").isNull(), "no source_files mapping")
    )
    per_manifest = manifests.select(
        own.alias("department"), F.lit(None).cast("string").alias("filename"), whole.alias("problem")
    )
    records = manifests.select(own.alias("department"), F.explode("source_files").alias("filename", "record"))
    empty = F.lit(False)
    for name in RECORD_FIELDS:
        empty = empty | F.col(f"record.{name}").isNull()
    single = (
        F.when(~F.coalesce(F.col("record.filename") == F.col("filename"), F.lit(False)), "invalid source record")
        .when(empty, "incomplete source record")
        .when(F.upper("record.department") != F.col("department"), "source department mismatch")
    )
    per_record = records.select("department", "filename", single.alias("problem"))
    return per_manifest.unionByName(per_record).where(F.col("problem").isNotNull())


def validated_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests, or an error naming the first violated rule."""
    manifests = read_manifests(spark, root)
    first = manifest_problems(manifests).orderBy("department", F.asc_nulls_first("filename")).take(1)
    if first:
        where = first[0].department + (f"/{first[0].filename}" if first[0].filename else "")
        raise ValueError(f"Manifest {where}: {first[0].problem}")
    return manifests


def source_records(manifests: DataFrame) -> DataFrame:
    """One row per source file of every manifest."""
    return manifests.select(
        F.upper("department").alias("owner"), "network_category", F.explode("source_files").alias("name", "record")
    ).select("record.*", F.coalesce("network_category", F.lit("main")).alias("network_category"))

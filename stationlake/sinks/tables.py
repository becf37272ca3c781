"""Writing facts, dimensions, metadata and manifests."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stationlake.schema import fact_schema
from stationlake.sources.facts import table_path
from stationlake.sources.files import child_folders, delete, exists, rename

# What a task gathers and a file holds at most, at up to ROW_BYTES a row.  A fact row takes some 1.5 KB while it is
# sorted, however well its empty columns compress: tasks are bounded by rows, not by the bytes of a shuffle.
FILE_BYTES = "256m"
ROW_BYTES = 1024
PARTITION = ("department", "year")
STATION_ORDER = (*PARTITION, "NUM_POSTE", "observation_time_utc")


def rows_per_task() -> int:
    units = {"k": 10, "m": 20, "g": 30}
    return max(1, (int(FILE_BYTES[:-1]) << units[FILE_BYTES[-1]]) // ROW_BYTES)


def arrange_facts(facts: DataFrame) -> tuple[DataFrame, set[int]]:
    """Facts gathered by department and year and sorted by station and time, and the years that they have.

    A task takes about :func:`rows_per_task` rows.  All department-years follow each other on one line of places, one per
    row, that is cut into tasks; station-days are hashed to the places of their department-year.  So small ones
    share a task, and one that holds much of the data is split over tasks and files.  The driver sees one
    count per department-year.
    """
    spark, most = facts.sparkSession, rows_per_task()
    counts = facts.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("rows")).orderBy(*PARTITION).collect()
    starts = list(itertools.accumulate((c.rows for c in counts), initial=0))
    tasks = max(1, -(-starts[-1] // most))
    line = spark.createDataFrame(
        [(c.department, c.year, start, c.rows) for c, start in zip(counts, starts, strict=False)],
        "_department string, _year int, _start bigint, _rows bigint",
    )
    same = F.col("department").eqNullSafe(F.col("_department")) & F.col("year").eqNullSafe(F.col("_year"))
    place = F.col("_start") + F.pmod(F.xxhash64("NUM_POSTE", F.to_date("observation_time_utc")), F.col("_rows"))
    dealt = facts.join(F.broadcast(line), same).repartitionById(tasks, F.floor(place / most).cast("int"))
    arranged = dealt.select(*facts.columns).sortWithinPartitions(*STATION_ORDER)
    return arranged, {c.year for c in counts}


def replace_fact_partitions(facts: DataFrame, root: str, table: str, department: str, years: list[int]) -> None:
    """Replace the affected (department, year) partitions of a table.

    Dynamic overwrite leaves other partitions alone.  It also leaves affected
    years without new rows, and those are removed afterwards.
    """
    spark = facts.sparkSession
    path = table_path(root, table)
    columns = [field.name for field in fact_schema(table).fields]
    arranged, present = arrange_facts(facts.select(*columns))
    (
        arranged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*PARTITION)
        .parquet(path)
    )
    for year in sorted(set(years) - present):
        folder = f"{path}/department={department}/year={year}"
        if exists(spark, folder):
            delete(spark, folder)


def stage_facts(facts: DataFrame, folder: str, table: str) -> tuple[DataFrame, int]:
    """Facts written aside under the layout of their table, and the rows that the write itself counted."""
    spark = facts.sparkSession
    path = table_path(folder, table)
    schema = fact_schema(table)
    seen = Observation(f"staged-{table}")
    arranged, _ = arrange_facts(facts.select(*schema.fieldNames()))
    counted = arranged.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("compression", "zstd").partitionBy(*PARTITION).parquet(path)
    return spark.read.schema(schema).parquet(path), seen.get["rows"]


def publish_partitions(
    spark: SparkSession, folder: str, root: str, table: str, department: str, years: list[int]
) -> None:
    """Move staged (department, year) partitions into their table; affected years without staged rows go."""
    staged, live = (f"{table_path(base, table)}/department={department}" for base in (folder, root))
    for year in sorted(years):
        target = f"{live}/year={year}"
        if exists(spark, target):
            delete(spark, target)
        if exists(spark, f"{staged}/year={year}"):
            rename(spark, f"{staged}/year={year}", target)


def materialized_years(spark: SparkSession, root: str, department: str) -> list[int]:
    folders = child_folders(spark, f"{table_path(root, 'hourly_core')}/department={department}")
    return sorted(int(name.split("=", 1)[1]) for name in folders if name.startswith("year="))


def materialized_departments(spark: SparkSession, root: str, table: str) -> list[str]:
    folders = child_folders(spark, table_path(root, table))
    return sorted(name.split("=", 1)[1].upper() for name in folders if name.startswith("department="))


def write_station_dimension(stations: DataFrame, root: str, table: str, department: str) -> None:
    """Station tables of one department."""
    (
        stations.withColumn("department", F.lit(department))
        .repartitionByRange("NUM_POSTE")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("department")
        .parquet(table_path(root, table))
    )


def write_small_table(rows: DataFrame, root: str, table: str, order: list[str]) -> None:
    """A lookup table (metrics, departments, source files) as a whole.

    It is written aside and moved into place, because it may be computed from
    the table it replaces.
    """
    spark = rows.sparkSession
    path = table_path(root, table)
    aside = f"{path}.next"
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(aside)
    delete(spark, path)
    rename(spark, aside, path)


def append_run(run: DataFrame, root: str) -> None:
    """Add a row to the run log."""
    run.coalesce(1).write.mode("append").parquet(table_path(root, "processing_runs"))


def write_manifest(manifest: DataFrame, root: str, department: str) -> None:
    """Manifest of one department, as one JSON record."""
    path = f"{root.rstrip('/')}/manifests/department={department}"
    manifest.coalesce(1).write.mode("overwrite").json(path)


def write_failure(report: DataFrame, root: str, run_id: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/metadata/failures/{run_id}")

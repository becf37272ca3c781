"""Validation and comparison of facts, sources, manifests and metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions import timeops, values
from stationlake.schema import (
    DATASET_VERSION,
    LOCAL_ZONE,
    NETWORK_CATEGORY,
    TRANSFORMATION_VERSION,
)
from stationlake.session import stored

FACT_KEY = ("network_category", "NUM_POSTE", "observation_time_utc")


def hours_by_year(rows: DataFrame, keys: list[str], instant: Column) -> DataFrame:
    """Rows and different hours per group of keys and UTC year.

    The hours are bits of one bitmap per group, combined before the shuffle: a
    station-year travels as one row, not as its eight thousand observations.
    """
    hours = F.bitmap_count(F.bitmap_construct_agg(timeops.hour_of_year(instant)))
    return rows.groupBy(*keys, F.year(instant).alias("hour_year")).agg(F.count("*").alias("rows"), hours.alias("hours"))


def in_crowded_years(rows: DataFrame, keys: list[str], instant: Column) -> DataFrame:
    """The rows of groups and years that have more rows than hours: all others hold no hour twice.

    Those years are stored, so that their size is known before rows meet them.
    """
    counted = hours_by_year(rows, keys, instant).where(F.col("rows") > F.col("hours"))
    names = {name: f"crowded_{name}" for name in (*keys, "hour_year")}
    crowded = stored(counted.select(*[F.col(name).alias(other) for name, other in names.items()]), "crowded-years")
    same = F.year(instant).eqNullSafe(crowded["crowded_hour_year"])
    for name in keys:
        same = same & rows[name].eqNullSafe(crowded[names[name]])
    return rows.join(crowded, same, "left_semi")


def duplicate_station_hours(facts: DataFrame) -> DataFrame:
    """Station-hour keys stored more than once."""
    suspects = in_crowded_years(facts.select(*FACT_KEY), ["network_category", "NUM_POSTE"], F.col("observation_time_utc"))
    return suspects.groupBy(*FACT_KEY).agg(F.count("*").alias("copies")).where("copies > 1")


def compare_keys(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, unexpected or duplicated on the observed side.

    Both sides meet in one grouping, so a single shuffle of keys is enough.
    """
    tagged = expected.select(*keys).distinct().withColumns({"wanted": F.lit(1), "found": F.lit(0)})
    seen = observed.select(*keys).withColumns({"wanted": F.lit(0), "found": F.lit(1)})
    merged = tagged.unionByName(seen).groupBy(*keys).agg(
        F.sum("wanted").alias("wanted"), F.sum("found").alias("found")
    )
    issue = (
        F.when(F.col("found") == 0, "missing")
        .when(F.col("wanted") == 0, "unexpected")
        .when(F.col("found") > 1, "duplicate")
    )
    return merged.withColumn("issue", issue).where("issue is not null").select(*keys, "issue", "found")


def without_years(facts: DataFrame, department: str, years: list[int]) -> DataFrame:
    """Published facts of a department outside the affected years."""
    return facts.where((F.col("department") == department) & ~F.col("year").isin(years))


def facts_for_dimensions(published: DataFrame, staged: DataFrame, affected: DataFrame) -> DataFrame:
    """Untouched published partitions and the staged ones (keys: department, year)."""
    kept = published.join(affected, ["department", "year"], "left_anti")
    return kept.unionByName(staged, allowMissingColumns=True)


def diff_sources(current: DataFrame, previous: DataFrame) -> DataFrame:
    """New, changed, removed and unchanged source files against a manifest."""
    keys = ["department", "filename"]
    now = current.select(
        *keys, F.col("sha256").alias("new_sha"), F.col("period_start").alias("new_start"),
        F.col("period_end").alias("new_end"),
    )
    then = previous.select(
        *keys, F.col("sha256").alias("old_sha"), F.col("period_start").alias("old_start"),
        F.col("period_end").alias("old_end"), F.lit(True).alias("known"),
    )
    merged = now.join(then, keys, "full")
    change = (
        F.when(F.col("new_sha").isNull(), "removed")
        .when(F.col("known").isNull(), "new")
        .when(~F.col("new_sha").eqNullSafe(F.col("old_sha")), "changed")
        .otherwise("unchanged")
    )
    return merged.select(
        *keys,
        change.alias("change"),
        F.coalesce("new_start", "old_start").cast("int").alias("period_start"),
        F.coalesce("new_end", "old_end").cast("int").alias("period_end"),
    )


def affected_years(changes: DataFrame) -> DataFrame:
    """Every year in the period of a new, changed or removed file, per department."""
    touched = changes.where("change <> 'unchanged'")
    return touched.select(
        "department", F.explode(F.sequence("period_start", "period_end")).alias("year")
    ).distinct()


def years_of_files(files: DataFrame) -> DataFrame:
    """Years covered by the archives of each department."""
    return files.select(
        "department", F.explode(F.sequence("period_start", "period_end")).alias("year")
    ).distinct()


def dataset_status(manifests: DataFrame, raw_departments: DataFrame, changes: DataFrame) -> DataFrame:
    """State of every materialised department.

    ``manifests`` has department, dataset_version and transformation_version,
    ``raw_departments`` the departments that still have archives.
    """
    counts = changes.groupBy("department").agg(
        F.count_if(F.col("change") != "removed").alias("source_archives"),
        F.count_if(F.col("change").isin("new", "changed")).alias("changed_archives"),
        F.count_if(F.col("change") == "removed").alias("removed_archives"),
    )
    years = affected_years(changes).groupBy("department").agg(
        F.array_sort(F.collect_list("year")).alias("affected_years")
    )
    sources = raw_departments.select("department", F.lit(True).alias("has_sources")).distinct()
    state = (
        F.when(F.col("has_sources").isNull(), "error")
        .when(
            (F.col("dataset_version") != DATASET_VERSION)
            | (F.col("transformation_version") != TRANSFORMATION_VERSION),
            "rebuild",
        )
        .when((F.col("changed_archives") > 0) | (F.col("removed_archives") > 0), "pending")
        .otherwise("up-to-date")
    )
    joined = (
        manifests.join(sources, "department", "left")
        .join(counts, "department", "left")
        .join(years, "department", "left")
    )
    broken = state == "error"

    def unless_broken(name: str) -> Column:
        return F.when(broken, F.lit(0)).otherwise(F.coalesce(name, F.lit(0))).cast("bigint").alias(name)

    none = F.array().cast("array<int>")
    return joined.select(
        "department",
        state.alias("status"),
        *[unless_broken(n) for n in ("source_archives", "changed_archives", "removed_archives")],
        F.when(broken, none).otherwise(F.coalesce("affected_years", none)).alias("affected_years"),
        F.when(
            broken, F.concat(F.lit("No verified local hourly archives found for department "), "department")
        ).alias("error"),
    )


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("departments"))


def raw_only_departments(raw: DataFrame, manifests: DataFrame) -> DataFrame:
    """Departments with archives that were never materialised."""
    return raw.select("department").distinct().join(manifests, "department", "left_anti")


def set_difference(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(observed, key, "left_anti")


def department_rows(departments: DataFrame) -> DataFrame:
    """The departments dimension from the departments of the manifests."""
    code = F.col("department")
    return departments.select(F.upper("department").alias("department")).distinct().select(
        "department",
        values.department_name(code).alias("department_name"),
        F.lit("UTC").alias("source_time_convention"),
        F.lit(LOCAL_ZONE).alias("analytical_timezone"),
        F.lit("metropolitan").alias("geography_class"),
    )


def source_file_rows(records: DataFrame) -> DataFrame:
    """The source-files table from the records of the manifests."""
    network = (
        F.coalesce("network_category", F.lit(NETWORK_CATEGORY))
        if "network_category" in records.columns
        else F.lit(NETWORK_CATEGORY)
    )
    return records.select(
        "filename",
        F.upper("department").alias("department"),
        F.col("period_start").cast("bigint").alias("period_start"),
        F.col("period_end").cast("bigint").alias("period_end"),
        F.col("size").cast("bigint").alias("size"),
        F.col("mtime_ns").cast("bigint").alias("mtime_ns"),
        "sha256",
        network.alias("network_category"),
    )

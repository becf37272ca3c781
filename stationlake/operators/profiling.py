"""Profiles of raw archive rows: inventory, columns, codes, duplicates, conflicts.

Input rows carry ``source_file``, ``period_start``, ``period_end``,
``source_row_number`` and ``is_malformed`` next to the archive's own columns, all
text.  Header tables have one row per file with its ``columns`` array.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions import timeops, values
from stationlake.operators.audits import hours_by_year, in_crowded_years
from stationlake.schema import DASHBOARD_COLUMNS

FILE_FIELDS = ("source_file", "period_start", "period_end")
ROW_FIELDS = (*FILE_FIELDS, "source_row_number", "is_malformed")
STATION, RAW_TIME = "NUM_POSTE", "AAAAMMJJHH"
EXAMPLES = 3
COMPLETE_SHARE = 0.9


def archive_columns(rows: DataFrame) -> list[str]:
    return [name for name in rows.columns if name not in ROW_FIELDS]


def completed(rows: DataFrame, *names: str) -> DataFrame:
    """The rows with NULL text for columns that none of the archives has, such as T in old ones."""
    absent = [name for name in names if name not in rows.columns]
    return rows.withColumns({name: F.lit(None).cast("string") for name in absent}) if absent else rows


def well_formed(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_malformed"))


def timed_rows(rows: DataFrame) -> DataFrame:
    """Well-formed rows with a valid timestamp; a blank station code stays a value."""
    good = well_formed(completed(rows, STATION, RAW_TIME)).withColumns(
        {
            STATION: F.coalesce(F.col(STATION), F.lit("")),
            "instant": timeops.parse_observation_time(F.col(RAW_TIME)),
        }
    )
    return good.where(F.col("instant").isNotNull())


def archive_inventory(
    rows: DataFrame, headers: DataFrame | None = None, stations_need_time: bool = False
) -> DataFrame:
    """Rows, stations, malformed and invalid counts and the time span per file.

    The plain inventory counts a station even when its timestamps are invalid;
    the department exploration does not (``stations_need_time``).
    """
    times_known = RAW_TIME in rows.columns
    rows = completed(rows, STATION, RAW_TIME)
    good = ~F.col("is_malformed")
    instant = timeops.parse_observation_time(F.col(RAW_TIME))
    counts_station = good & values.is_populated(F.col(STATION))
    if stations_need_time:
        counts_station = good & instant.isNotNull()
    inventory = rows.groupBy(*FILE_FIELDS).agg(
        F.count("*").alias("row_count"),
        F.count_if("is_malformed").alias("malformed_rows"),
        F.count_distinct(F.when(counts_station, F.coalesce(F.col(STATION), F.lit("")))).alias("station_count"),
        F.count_if(good & instant.isNull() & F.lit(times_known)).alias("invalid_timestamps"),
        F.min(F.when(good, instant)).alias("earliest"),
        F.max(F.when(good, instant)).alias("latest"),
    )
    if headers is not None:
        timed = headers.select("source_file", F.array_contains("columns", RAW_TIME).alias("has_time"))
        inventory = inventory.join(timed, "source_file", "left").withColumn(
            "invalid_timestamps",
            F.when(F.coalesce("has_time", F.lit(True)), F.col("invalid_timestamps")).otherwise(F.lit(0)),
        )
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return inventory.select(
        *FILE_FIELDS, "row_count", "station_count",
        F.date_format("earliest", iso).alias("earliest_timestamp"),
        F.date_format("latest", iso).alias("latest_timestamp"),
        "malformed_rows", "invalid_timestamps",
    )


def schema_groups(headers: DataFrame) -> DataFrame:
    """Files per distinct header, with the smallest file as its example."""
    named = headers.withColumn("schema_id", values.schema_fingerprint(F.col("columns")))
    return named.groupBy("schema_id").agg(
        F.first("columns").alias("columns"),
        F.count("*").alias("file_count"),
        F.min_by("source_file", F.struct("compressed_size", "source_file")).alias("representative_file"),
        F.min("period_start").alias("earliest_period"),
        F.max("period_end").alias("latest_period"),
    )


def column_coverage(headers: DataFrame) -> DataFrame:
    """In how many archives each column occurs."""
    listed = headers.select("source_file", F.explode(F.array_distinct("columns")).alias("column"))
    archives = headers.agg(F.count("*")).scalar()
    return listed.groupBy("column").agg(F.count("*").alias("archive_count")).withColumn(
        "archive_percentage", values.percentage(F.col("archive_count"), archives)
    )


def quality_targets(columns: DataFrame) -> DataFrame:
    """Column a quality column belongs to, where that column exists."""
    known = columns.select(F.col("column").alias("quality_for"))
    pairs = columns.where(F.col("column").startswith("Q")).select(
        "column", F.substring("column", 2, 1_000).alias("quality_for")
    )
    return columns.join(pairs.join(known, "quality_for", "left_semi"), "column", "left")


def column_dictionary(
    coverage: DataFrame, descriptions: DataFrame, archives: Column | None = None
) -> DataFrame:
    """Columns with official text, quality target and coverage.

    ``archives`` is the number of selected archives when it includes unreadable ones.
    """
    official = descriptions.select(F.col("name").alias("column"), "description")
    joined = quality_targets(coverage.select("column")).join(coverage, "column").join(
        official, "column", "left"
    )
    share = F.col("archive_percentage")
    if archives is not None:
        share = values.percentage(F.col("archive_count"), archives)
    return joined.select(
        "column", "description", F.col("description").isNotNull().alias("documented"),
        "quality_for", "archive_count", share.alias("archive_percentage"),
    )


def value_counts(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per (file, column, value) and the first row that has the value.

    For columns of few values, such as codes.  Unpivoting multiplies rows, but they collapse to distinct
    values before anything is shuffled.  Blank values keep one NULL group per column.
    """
    names = list(columns or archive_columns(rows))
    keys = [*FILE_FIELDS, "source_row_number"]
    texts = well_formed(rows).select(
        *keys, *[values.blank_to_null(F.col(name).cast("string")).alias(name) for name in names]
    )
    return (
        texts.unpivot(keys, names, "column", "value")
        .groupBy(*FILE_FIELDS, "column", "value")
        .agg(F.count("*").alias("rows"), F.min("source_row_number").alias("first_row"))
    )


SUMMARY_FIELDS = (
    "source_file string, period_start int, period_end int, column string, valid_rows bigint, populated_count bigint, "
    "numeric_count bigint, numeric_min double, numeric_max double, firsts array<struct<row: bigint, value: string>>"
)
# Files whose buffers a task holds at a time; more are passed on and merged later.
HELD_FILES = 64


class _ColumnBuffer:
    """What a task knows of one column of one file: counts, range, and the first different values."""

    __slots__ = ("rows", "populated", "numeric", "least", "most", "firsts")

    def __init__(self) -> None:
        self.rows = self.populated = self.numeric = 0
        self.least = self.most = None
        self.firsts: dict[str, int] = {}

    def add(self, order: np.ndarray, texts: pa.Array, numbers: np.ndarray, known: np.ndarray) -> None:
        """A batch of the column, with row numbers in rising order."""
        self.rows += len(texts)
        self.populated += len(texts) - texts.null_count
        self.numeric += int(known.sum())
        good = numbers[known & ~np.isnan(numbers)]
        if len(good):
            self.least = float(good.min()) if self.least is None else min(self.least, float(good.min()))
            self.most = float(good.max()) if self.most is None else max(self.most, float(good.max()))
        if texts.null_count == len(texts):
            return
        # Rows behind three different values cannot change them.
        if len(self.firsts) == EXAMPLES and order[0] > max(self.firsts.values()):
            return
        for value in pc.unique(texts.drop_null()).slice(0, EXAMPLES):
            row = int(order[pc.index(texts, value).as_py()])
            text = value.as_py()
            self.firsts[text] = min(row, self.firsts.get(text, row))
        self.firsts = dict(sorted(self.firsts.items(), key=lambda item: item[1])[:EXAMPLES])


def _partial_summaries(names: list[str]):
    """Arrow batches of (file fields, row number, texts, numbers) to one row per file, column and task."""

    def passed_on(held: dict) -> pa.RecordBatch:
        rows = [
            (*file, name, b.rows, b.populated, b.numeric, b.least, b.most, [{"row": r, "value": v} for v, r in b.firsts.items()])
            for file, buffers in held.items()
            for name, b in zip(names, buffers, strict=True)
        ]
        first = pa.list_(pa.struct([("row", pa.int64()), ("value", pa.string())]))
        types = [
            ("source_file", pa.string()), ("period_start", pa.int32()), ("period_end", pa.int32()), ("column", pa.string()),
            *[(n, pa.int64()) for n in ("valid_rows", "populated_count", "numeric_count")],
            *[(n, pa.float64()) for n in ("numeric_min", "numeric_max")], ("firsts", first),
        ]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], [n for n, _ in types])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[_ColumnBuffer]] = {}
        width = len(names)
        for batch in batches:
            files = [batch.column(at).to_pylist() for at in range(len(FILE_FIELDS))]
            codes: dict[tuple, int] = {}
            code = np.array([codes.setdefault(file, len(codes)) for file in zip(*files, strict=True)])
            order = batch.column(len(FILE_FIELDS)).to_numpy()
            by_file = np.lexsort((order, code))
            texts, numbers = batch.column(4).flatten(), batch.column(5).flatten()
            known = numbers.is_valid().to_numpy(zero_copy_only=False)
            plain = pc.fill_null(numbers, 0.0).to_numpy(zero_copy_only=False)
            ends = np.searchsorted(code[by_file], np.arange(len(codes) + 1))
            for at in range(width):
                cells = by_file * width + at
                column, seen, value = texts.take(pa.array(cells)), known[cells], plain[cells]
                for file, n in codes.items():
                    first, after = ends[n], ends[n + 1]
                    buffers = held.setdefault(file, [_ColumnBuffer() for _ in names])
                    buffers[at].add(order[by_file[first:after]], column.slice(first, after - first), value[first:after], seen[first:after])
            if len(held) > HELD_FILES:
                yield passed_on(held)
                held = {}
        if held:
            yield passed_on(held)

    return run


def column_summaries(rows: DataFrame) -> DataFrame:
    """One row per file and column: rows, populated and numeric values, range, and the first different values.

    Each task keeps a buffer of fixed size per (file, column) and sends it once; the merge adds up counts and
    takes the first values of the buffers' first values.  So what is shuffled does not depend on the values.
    """
    names = archive_columns(rows)
    texts = F.array(*[values.blank_to_null(F.col(name).cast("string")) for name in names])
    needed = well_formed(rows).select(*FILE_FIELDS, F.col("source_row_number").cast("bigint"), texts.alias("texts"))
    parsed = needed.withColumn("numbers", F.transform("texts", values.parse_number))
    partial = parsed.mapInArrow(_partial_summaries(names), SUMMARY_FIELDS)
    # A value's rows in several buffers come in order, so its first one counts.
    firsts = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("firsts"))),
        F.array().cast("array<struct<row: bigint, value: string>>"),
        lambda kept, item: F.when(
            (F.size(kept) >= EXAMPLES) | F.exists(kept, lambda k: k["value"] == item["value"]), kept
        ).otherwise(F.concat(kept, F.array(item))),
    )
    added = ("valid_rows", "populated_count", "numeric_count")
    return partial.groupBy(*FILE_FIELDS, "column").agg(
        *[F.sum(name).alias(name) for name in added],
        F.min("numeric_min").alias("numeric_min"),
        F.max("numeric_max").alias("numeric_max"),
        firsts.alias("firsts"),
    )


def first_examples(summaries: DataFrame) -> DataFrame:
    """The first distinct values of each column in file order."""
    listed = summaries.select("source_file", "column", F.posexplode("firsts").alias("n", "first"))
    return listed.select(
        "source_file", "column", F.col("first.value").alias("value"), F.col("first.row").alias("first_row"),
        (F.col("n") + 1).alias("place"),
    )


def _with_inferred(summaries: DataFrame) -> DataFrame:
    """Summaries with the inferred type and the examples as a JSON list."""
    numeric = (F.col("populated_count") > 0) & (F.col("numeric_count") == F.col("populated_count"))
    return summaries.withColumns(
        {
            "inferred_type": F.when(numeric, "numeric").otherwise("string"),
            "examples": F.to_json(F.transform("firsts", lambda item: item["value"])),
        }
    )


def column_profile(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Population, inferred type, numeric range and examples per file and column."""
    profile = _with_inferred(column_summaries(rows))
    if headers is not None:
        listed = headers.select(*FILE_FIELDS, F.explode("columns").alias("column"))
        profile = listed.join(profile.drop("period_start", "period_end"), ["source_file", "column"], "left")
    zero = F.lit(0).cast("bigint")
    populated = F.coalesce("populated_count", zero)
    valid = F.coalesce("valid_rows", zero)
    return profile.select(
        *FILE_FIELDS,
        "column",
        populated.alias("populated_count"),
        (valid - populated).alias("null_count"),
        values.percentage(populated, valid).alias("coverage_percentage"),
        F.coalesce("inferred_type", F.lit("string")).alias("inferred_type"),
        "numeric_min",
        "numeric_max",
        F.coalesce("examples", F.lit("[]")).alias("examples"),
        F.col("column").isin(*DASHBOARD_COLUMNS).alias("is_core_dashboard_field"),
    )


def repeated_keys(rows: DataFrame) -> DataFrame:
    """Repeats of a (station, raw time) key per file, beyond the first.

    A valid time is one hour, so a station-year's repeats are its rows less its hours; only keys
    without a valid time are grouped one by one.
    """
    name = "duplicate_station_timestamp_count"
    if STATION not in rows.columns or RAW_TIME not in rows.columns:
        return rows.select("source_file").distinct().withColumn(name, F.lit(0).cast("bigint"))
    instant = timeops.parse_observation_time(F.col(RAW_TIME))
    keyed = well_formed(rows).select("source_file", STATION, RAW_TIME, instant.alias("instant"))
    timed = hours_by_year(keyed.where("instant IS NOT NULL"), ["source_file", STATION], F.col("instant"))
    others = keyed.where("instant IS NULL").groupBy("source_file", STATION, RAW_TIME).agg(
        F.count("*").alias("rows"), F.lit(1).cast("bigint").alias("hours")
    )
    both = timed.select("source_file", "rows", "hours").unionByName(others.select("source_file", "rows", "hours"))
    return both.groupBy("source_file").agg(F.sum(F.col("rows") - F.col("hours")).alias(name))


def distinct_values(rows: DataFrame) -> DataFrame:
    """Exact number of different values per file and column; equal ones are combined before the shuffle."""
    names = archive_columns(rows)
    texts = well_formed(rows).select(
        "source_file", *[values.blank_to_null(F.col(name).cast("string")).alias(name) for name in names]
    )
    different = texts.unpivot("source_file", names, "column", "value").where("value IS NOT NULL").distinct()
    return different.groupBy("source_file", "column").agg(F.count("*").alias("distinct_count"))


def archive_profile(rows: DataFrame) -> DataFrame:
    """Exact distinct counts, ranges, examples, repeats."""
    zero = F.lit(0).cast("bigint")
    return (
        _with_inferred(column_summaries(rows))
        .join(distinct_values(rows), ["source_file", "column"], "left")
        .join(repeated_keys(rows), "source_file", "left")
        .select(
            F.col("source_file").alias("filename"),
            "column",
            "inferred_type",
            "populated_count",
            F.coalesce("distinct_count", zero).alias("distinct_count"),
            "examples",
            "numeric_min",
            "numeric_max",
            F.coalesce("duplicate_station_timestamp_count", zero).alias("duplicate_station_timestamp_count"),
        )
    )


def quality_code_profile(rows: DataFrame) -> DataFrame:
    """Frequency of every quality and status code per file and column."""
    codes = [c for c in archive_columns(rows) if c.startswith(("Q", "STATUS_"))]
    counts = value_counts(rows, codes).where(F.col("value").isNotNull())
    # The window sees one row per distinct code, not the observations.
    whole = F.sum("rows").over(Window.partitionBy("source_file", "column"))
    return counts.select(
        "source_file",
        "column",
        "value",
        F.col("rows").alias("count"),
        values.percentage(F.col("rows"), whole).alias("percentage_of_populated"),
    )


_SETS = {"NOM_USUEL": "names", "LAT": "latitudes", "LON": "longitudes", "ALTI": "altitudes"}


def station_value_sets(rows: DataFrame) -> DataFrame:
    """Distinct metadata values, files, span and counts per station, as arrays.

    Hash aggregation to distinct tuples comes first, so the set-building
    aggregation sees a handful of rows per station.
    """
    tuples = timed_rows(completed(rows, *_SETS, "T")).groupBy(STATION, *_SETS, "source_file").agg(
        F.count("*").alias("observations"),
        F.count_if(values.is_populated(F.col("T"))).alias("temperatures"),
        F.min("instant").alias("first_time"),
        F.max("instant").alias("last_time"),
    )
    return tuples.groupBy(F.col(STATION).alias("station_id")).agg(
        *[
            F.array_sort(F.collect_set(values.blank_to_null(F.col(name)))).alias(label)
            for name, label in _SETS.items()
        ],
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.sum("observations").alias("observation_count"),
        F.sum("temperatures").alias("temperature_count"),
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
    )


def station_inventory(sets: DataFrame) -> DataFrame:
    """Station sets as report rows with JSON text."""
    return sets.select(
        "station_id",
        *[F.to_json(label).alias(label) for label in _SETS.values()],
        F.date_format("first_time", timeops.RAW_TIME_FORMAT).alias("first_timestamp_utc"),
        F.date_format("last_time", timeops.RAW_TIME_FORMAT).alias("last_timestamp_utc"),
        "observation_count",
        "temperature_count",
        F.to_json("source_files").alias("source_files"),
    )


def metadata_conflicts(sets: DataFrame) -> DataFrame:
    """Stations with more than one value in a metadata field."""
    fields = {"names": "name", "latitudes": "latitude", "longitudes": "longitude", "altitudes": "altitude"}
    listed = F.explode(
        F.array(*[F.struct(F.lit(field).alias("field"), F.col(label).alias("found")) for label, field in fields.items()])
    )
    return (
        sets.select("station_id", listed.alias("item"))
        .where(F.size("item.found") > 1)
        .select(
            "station_id",
            F.col("item.field").alias("field"),
            F.to_json("item.found").alias("values"),
            F.size("item.found").alias("value_count"),
        )
    )


def station_year_coverage(rows: DataFrame) -> DataFrame:
    """Observations and temperatures per station and year against a full year."""
    year = F.year("instant")
    counts = timed_rows(completed(rows, "T")).groupBy(F.col(STATION).alias("station_id"), year.alias("year")).agg(
        F.count("*").alias("observation_count"),
        F.count_if(values.is_populated(F.col("T"))).alias("temperature_count"),
    )
    expected = timeops.expected_year_hours(F.col("year"))
    share = F.col("temperature_count")
    return counts.withColumns(
        {
            "expected_hours": expected,
            "temperature_coverage_percentage": F.lit(100.0) * share / expected,
            "has_90_percent_temperature_coverage": share >= expected * F.lit(COMPLETE_SHARE),
        }
    )


def duplicate_observations(rows: DataFrame) -> DataFrame:
    """Station-hours recorded more than once, with the files they come from.

    Only station-years with more rows than hours can hold any, and only their rows are shuffled: keys are
    counted first (numbers in the buffers), and file names gathered for repeated keys alone.
    """
    timed = timed_rows(rows).select(
        F.col(STATION).alias("station_id"), F.col(RAW_TIME).alias("timestamp"), "source_file", "instant"
    )
    keyed = in_crowded_years(timed, ["station_id"], F.col("instant")).drop("instant")
    keys = ["station_id", "timestamp"]
    repeated = keyed.groupBy(*keys).count().where("count > 1").select(*keys)
    per_file = keyed.join(repeated, keys, "left_semi").groupBy(*keys, "source_file").count()
    return per_file.groupBy(*keys).agg(
        F.sum("count").alias("record_count"),
        F.count("*").alias("source_file_count"),
        F.array_sort(F.collect_list("source_file")).alias("source_files"),
    )


def archive_overlaps(duplicates: DataFrame) -> DataFrame:
    """Duplicates that span more than one archive."""
    return duplicates.where("source_file_count > 1")


def _count_as(frame: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
    counted = F.count("*") if condition is None else F.count_if(condition)
    return frame.groupBy().agg(counted.alias("n")).select(F.lit(name).alias("measure"), "n")


SUMMARY_MEASURES = (
    "archives", "stations", "errors", "duplicates", "cross_archive_overlaps",
    "station_years_with_90_percent_temperature", "metadata_conflicts",
)


def exploration_summary(
    inventory: DataFrame, stations: DataFrame, duplicates: DataFrame,
    years: DataFrame, conflicts: DataFrame,
) -> DataFrame:
    """One row of headline counts over the exploration reports."""
    failed = (
        F.col("inspection_error").isNotNull() if "inspection_error" in inventory.columns else F.lit(False)
    )
    parts = [
        _count_as(inventory, "archives"),
        _count_as(stations, "stations"),
        _count_as(inventory, "errors", failed),
        _count_as(duplicates, "duplicates"),
        _count_as(duplicates, "cross_archive_overlaps", F.col("source_file_count") > 1),
        _count_as(years, "station_years_with_90_percent_temperature", F.col("has_90_percent_temperature_coverage")),
        _count_as(conflicts, "metadata_conflicts"),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.groupBy().pivot("measure", list(SUMMARY_MEASURES)).agg(F.sum("n"))

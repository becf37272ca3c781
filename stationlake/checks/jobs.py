"""Checks of jobs on files: archives derived from the test tables, and what is built from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stationlake.checks.fixtures import RAW_COLUMNS, STATION_HOUR_COLUMNS
from stationlake.checks.observations import BEST_STATION, _comparison_sql
from stationlake.checks.places import BOUNDS, EDGES, GRID, INSIDE, SITES, STEP, _estimate_sql, _nearest_sql
from stationlake.checks.profiles import CONFLICTS, DUPLICATES, GOOD, ISO, TIME
from stationlake.checks.registry import plain_times, query, rounded
from stationlake.operators import audits, profiling, stations
from stationlake.operators.selection import Selection
from stationlake.plans import inspection, repair, sync, views
from stationlake.schema import fact_schema
from stationlake.session import shared_folder, stored
from stationlake.sinks.reports import export_csv, report_provenance, write_report
from stationlake.sinks.tables import replace_fact_partitions
from stationlake.sources import archives as raw
from stationlake.sources.boundaries import read_boundaries as read_geojson
from stationlake.sources.facts import read_table, register_views
from stationlake.sources.files import create_stream, list_files, open_stream

_DERIVED: dict[tuple[str, str, str], str] = {}


def _write_archives(rows, columns, root: str) -> None:
    """Archives of one gzip file each, header first, lines in order.

    The lines are sorted by all tasks together; an archive is the row of the gzip members that they wrote, and
    is copied in chunks.
    """
    spark = rows.sparkSession
    header = rows.select("source_file").distinct().select(
        "source_file", F.lit(-1).cast("bigint").alias("place"), F.lit(";".join(columns)).alias("line")
    )
    parts = f"{root}-parts"
    (
        stored(rows.select("source_file", "place", "line").unionByName(header), "lines", f"{root}-lines")
        .repartitionByRange("source_file", "place")
        .sortWithinPartitions("source_file", "place")
        .drop("place")
        .write.partitionBy("source_file")
        .option("compression", "gzip")
        .text(parts)
    )

    def join_members(batches):
        for batch in batches:
            for target, members in zip(batch["target"], batch["members"], strict=True):
                with create_stream(target) as output:
                    for member in members:
                        with open_stream(member) as stream:
                            while chunk := stream.read(1 << 20):
                                output.write(chunk)
            yield batch[["target"]]

    # Names only; those of an archive's members follow the order of the tasks that wrote them.
    members = list_files(spark, parts, "part-*", recursive=True).select(
        F.concat(F.lit(f"{root}/"), F.regexp_extract("path", "source_file=([^/]+)/", 1)).alias("target"), "path"
    ).groupBy("target").agg(F.sort_array(F.collect_list("path")).alias("members"))
    members.repartition("target").mapInPandas(join_members, "target string").count()


def _once(t, kind: str, build) -> str:
    """Folder built once per session and test folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, kind)
    if key not in _DERIVED:
        root = shared_folder(t.spark, kind)
        build(root)
        _DERIVED[key] = root
    return _DERIVED[key]


def raw_archives(t) -> str:
    """The raw fixture as archives: some lines short, some blank, some times invalid."""

    def build(root):
        event = F.col("source_row_number") - 2
        line = (
            F.when(event % 997 == 0, "")
            .when(event % 401 == 0, "short;line")
            .otherwise(F.concat_ws(";", *RAW_COLUMNS))
        )
        rows = t.raw.select("source_file", F.col("source_row_number").alias("place"), line.alias("line"))
        _write_archives(rows, RAW_COLUMNS, root)

    return _once(t, "archives", build)


def station_hour_archives(t) -> str:
    def build(root):
        order = F.xxhash64("NUM_POSTE", "AAAAMMJJHH").bitwiseAND((1 << 62) - 1)
        line = F.concat_ws(";", *STATION_HOUR_COLUMNS)
        rows = t.view("station_hours").select("source_file", order.alias("place"), line.alias("line"))
        _write_archives(rows, STATION_HOUR_COLUMNS, root)

    return _once(t, "station-hours", build)


def dataset(t) -> str:
    """A published dataset, synchronised from the station-hour archives."""
    source = station_hour_archives(t)

    def build(root):
        result = sync.sync_department(t.spark, source, root, f"{root}/no-dictionary", "44")
        if result.status != "synchronized":
            raise ValueError(f"{result.status}: {result.error}")

    return _once(t, "dataset", build)


# ------------------------------------------------------------------- archives
@query(
    "scan_hourly_archives",
    """
    SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY source_row_number) + 1
             AS source_row_number, is_malformed,
           CASE WHEN NOT is_malformed THEN NUM_POSTE END AS NUM_POSTE,
           CASE WHEN NOT is_malformed THEN AAAAMMJJHH END AS AAAAMMJJHH,
           CASE WHEN NOT is_malformed THEN nullif(T, '') END AS T,
           CASE WHEN NOT is_malformed THEN NOM_USUEL END AS NOM_USUEL FROM raw
    """,
    ("raw",),
)
def scan_hourly_archives(t):
    headers = raw.probe_headers(raw.discover_archives(t.spark, raw_archives(t)))
    rows = raw.stage_archives(t.spark, headers, shared_folder(t.spark, "scan"))
    kept = ("NUM_POSTE", "AAAAMMJJHH", "T", "NOM_USUEL")
    return rows.select(
        "source_file", "source_row_number", "is_malformed",
        *[F.when(~F.col("is_malformed"), F.col(c)).alias(c) for c in kept],
    )


@query(
    "source_row_number",
    """
    SELECT source_file, max(n) AS last_row, min(n) AS first_row, count(DISTINCT n) AS numbers FROM
      (SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY source_row_number) + 1 AS n FROM raw)
    GROUP BY 1
    """,
    ("raw",),
)
def source_row_number(t):
    headers = raw.probe_headers(raw.discover_archives(t.spark, raw_archives(t)))
    rows = raw.stage_archives(t.spark, headers, shared_folder(t.spark, "scan"))
    number = F.col("source_row_number")
    return rows.groupBy("source_file").agg(
        F.max(number).alias("last_row"), F.min(number).alias("first_row"),
        F.count_distinct(number).alias("numbers"),
    )


@query(
    "probe_archive_headers",
    f"""SELECT DISTINCT source_file AS filename, 'utf-8-sig' AS encoding, ';' AS delimiter,
               '{",".join(RAW_COLUMNS)}' AS columns, cast(NULL AS varchar) AS inspection_error FROM raw""",
    ("raw",),
)
def probe_archive_headers(t):
    headers = raw.probe_headers(raw.discover_archives(t.spark, raw_archives(t)))
    return headers.select(
        "filename", "encoding", "delimiter", F.array_join("columns", ",").alias("columns"), "inspection_error"
    )


@query(
    "source_fingerprints",
    "SELECT DISTINCT source_file AS filename, true AS same_digest FROM raw",
    ("raw",),
)
def source_fingerprints(t):
    root = raw_archives(t)
    hashed = raw.fingerprint_archives(raw.discover_archives(t.spark, root))
    content = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv.gz").load(root)
    direct = content.select("path", F.sha2("content", 256).alias("direct"))
    return hashed.join(direct, "path").select("filename", (F.col("sha256") == F.col("direct")).alias("same_digest"))


# -------------------------------------------------------------- published data
SYNCED = f"""
    SELECT '44' AS department, NUM_POSTE, NOM_USUEL, cast(LAT AS double) AS LAT, cast(LON AS double) AS LON,
           cast(ALTI AS int) AS ALTI, AAAAMMJJHH, {TIME} AS observation_time_utc,
           (({TIME} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris') AS observation_time_local,
           cast((({TIME} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris') AS date) AS local_date,
           cast(extract(hour FROM (({TIME} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris')) AS smallint) AS local_hour,
           cast(60 AS smallint) AS utc_offset_minutes, false AS is_dst, source_file,
           cast(cast(T AS real) AS double) AS T, cast(QT AS smallint) AS QT,
           cast(cast(nullif(RR1, '') AS real) AS double) AS RR1, cast(QRR1 AS smallint) AS QRR1,
           cast(year({TIME}) AS int) AS year FROM station_hours
    """


@query("sync_department", SYNCED, ("station_hours",))
def sync_department(t):
    facts = read_table(t.spark, dataset(t), "hourly_core")
    chosen = facts.select(
        "department", "NUM_POSTE", "NOM_USUEL", "LAT", "LON", "ALTI", "AAAAMMJJHH", "observation_time_utc",
        "observation_time_local", "local_date", "local_hour", "utc_offset_minutes", "is_dst", "source_file",
        F.col("T").cast("double").alias("T"), "QT", F.col("RR1").cast("double").alias("RR1"), "QRR1", "year",
    )
    return plain_times(chosen)


@query(
    "write_extension_facts",
    """
    SELECT 'hourly_surface' AS table_name, NUM_POSTE, AAAAMMJJHH, cast(T10 AS double) AS value
    FROM station_hours WHERE T10 <> ''
    UNION ALL SELECT 'hourly_marine', NUM_POSTE, AAAAMMJJHH, cast(TMER AS double) FROM station_hours WHERE TMER <> ''
    UNION ALL SELECT 'hourly_snow', NUM_POSTE, AAAAMMJJHH, cast(NEIGETOT AS double) FROM station_hours WHERE NEIGETOT <> ''
    """,
    ("station_hours",),
)
def write_extension_facts(t):
    root = dataset(t)
    parts = [
        read_table(t.spark, root, table).select(
            F.lit(table).alias("table_name"), "NUM_POSTE", "AAAAMMJJHH", F.col(metric).cast("double").alias("value")
        )
        for table, metric in (("hourly_surface", "T10"), ("hourly_marine", "TMER"), ("hourly_snow", "NEIGETOT"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "scan_fact_views",
    f"""SELECT '44' AS department, cast(year({TIME}) AS int) AS year, count(*) AS n,
               round(avg(cast(T AS real)), 4) AS mean FROM station_hours GROUP BY 2""",
    ("station_hours",),
)
def scan_fact_views(t):
    register_views(t.spark, dataset(t))
    return t.spark.sql(
        "SELECT department, year, count(*) AS n, round(avg(T), 4) AS mean FROM hourly_core GROUP BY department, year"
    )


@query(
    "write_dimensions",
    f"""SELECT '44' AS department, NUM_POSTE, any_value(NOM_USUEL) AS NOM_USUEL, min({TIME}) AS first_observation_utc,
               max({TIME}) AS last_observation_utc, 1::bigint AS name_variant_count FROM station_hours GROUP BY NUM_POSTE""",
    ("station_hours",),
)
def write_dimensions(t):
    stored = read_table(t.spark, dataset(t), "stations")
    return plain_times(
        stored.select(
            "department", "NUM_POSTE", "NOM_USUEL", "first_observation_utc", "last_observation_utc",
            "name_variant_count",
        )
    )


@query(
    "write_source_manifest",
    "SELECT DISTINCT source_file AS filename, '44' AS department, 'main' AS network_category FROM station_hours",
    ("station_hours",),
)
def write_source_manifest(t):
    from stationlake.sources.manifests import source_records, validated_manifests

    records = source_records(validated_manifests(t.spark, dataset(t)))
    return records.select("filename", "department", "network_category")


@query(
    "append_processing_run",
    "SELECT '44' AS department, 'success' AS status, count(*) AS source_rows, count(*) AS core_rows FROM station_hours",
    ("station_hours",),
)
def append_processing_run(t):
    runs = read_table(t.spark, dataset(t), "processing_runs")
    return runs.select("department", "status", "source_rows", "core_rows")


@query(
    "reconcile_row_count",
    "SELECT count(*) AS source_rows, count(*) AS stored_rows, 0::bigint AS repeated_keys FROM station_hours",
    ("station_hours",),
)
def reconcile_row_count(t):
    facts = read_table(t.spark, dataset(t), "hourly_core")
    keys = facts.groupBy(*audits.FACT_KEY).agg(F.count("*").alias("copies"))
    source = t.view("station_hours").agg(F.count("*")).scalar()
    return keys.agg(
        source.alias("source_rows"), F.sum("copies").alias("stored_rows"),
        F.count_if(F.col("copies") > 1).alias("repeated_keys"),
    )


@query(
    "repair_metadata",
    """SELECT DISTINCT '44' AS department, 'Loire-Atlantique' AS department_name, source_file AS filename
       FROM station_hours""",
    ("station_hours",),
)
def repair_metadata(t):
    root = dataset(t)
    repair.repair_metadata(t.spark, root)
    names = read_table(t.spark, root, "departments").select("department", "department_name")
    return read_table(t.spark, root, "source_files").join(names, "department").select(
        "department", "department_name", "filename"
    )


# --------------------------------------------------------------------- reports
@query(
    "inspect_archives",
    f"""
    SELECT source_file AS filename, split_part(source_file, '_', 2) AS department, period_start, period_end,
           'utf-8-sig' AS encoding, ';' AS delimiter, {len(RAW_COLUMNS)} AS column_count, count(*) AS row_count,
           count(DISTINCT NUM_POSTE) FILTER (WHERE NOT is_malformed) AS station_count,
           {ISO.format(f"min({TIME}) FILTER (WHERE NOT is_malformed)")} AS earliest_timestamp,
           {ISO.format(f"max({TIME}) FILTER (WHERE NOT is_malformed)")} AS latest_timestamp,
           count(*) FILTER (WHERE is_malformed) AS malformed_rows,
           count(*) FILTER (WHERE NOT is_malformed AND {TIME} IS NULL) AS invalid_timestamps
    FROM raw GROUP BY ALL
    """,
    ("raw",),
)
def inspect_archives(t):
    folder = shared_folder(t.spark, "reports")
    inspection.inspect_archives(t.spark, raw_archives(t), folder, "inventory")
    report = t.spark.read.parquet(f"{folder}/archive_inventory")
    return report.select(
        "filename", "department", "period_start", "period_end", "encoding", "delimiter", "column_count",
        "row_count", "station_count", "earliest_timestamp", "latest_timestamp", "malformed_rows",
        "invalid_timestamps",
    )


_EXPLORED = GOOD.replace("FROM raw WHERE", "FROM raw WHERE source_file LIKE 'H_44_%' AND")
_EXPLORED_DUPLICATES = DUPLICATES.split("WITH " + GOOD)[1]


@query(
    "explore_department",
    f"""
    WITH {_EXPLORED}, dup AS ({_EXPLORED_DUPLICATES}), conflicts AS ({CONFLICTS})
    SELECT 3::bigint AS archives, (SELECT count(DISTINCT NUM_POSTE) FROM good) AS stations, 0::bigint AS errors,
           (SELECT count(*) FROM dup) AS duplicates,
           (SELECT count(*) FROM dup WHERE source_file_count > 1) AS cross_archive_overlaps,
           0::bigint AS station_years_with_90_percent_temperature,
           (SELECT count(*) FROM conflicts) AS metadata_conflicts
    """,
    ("raw",),
)
def explore_department(t):
    """The report covers one department by definition; every row of its archives counts."""
    folder = shared_folder(t.spark, "reports")
    summary = inspection.explore_department(t.spark, raw_archives(t), folder, "44")
    names = list(summary)
    return t.spark.createDataFrame(
        [tuple(summary[n] for n in names)], ", ".join(f"{n} bigint" for n in names)
    )


# ----------------------------------------------------------------------- views
@query(
    "default_selection",
    """
    WITH f AS (SELECT * FROM obs WHERE department = '44'),
    y AS (SELECT max(year(local_date)) AS y, max(local_date) AS last_day FROM f)
    SELECT '44' AS department, cast('2024-01-01' AS date) AS start_date, (SELECT last_day FROM y) AS end_date,
           (SELECT NUM_POSTE FROM f GROUP BY 1
            ORDER BY count(T) DESC, date_diff('second', min(observation_time_utc), max(observation_time_utc)) DESC, 1
            LIMIT 1) AS station
    """,
    ("obs",),
)
def default_selection(t):
    departments = t.obs.select("department").distinct().withColumn("department_name", F.col("department"))
    chosen = views.default_selection(t.obs, departments)
    return t.spark.createDataFrame(
        [(chosen.department, chosen.start, chosen.end, chosen.stations[0])],
        "department string, start_date date, end_date date, station string",
    )


@query(
    "resolve_period",
    """SELECT cast(max(year(local_date)) AS int) AS year, make_date(max(year(local_date)), 1, 1) AS start_date,
              max(local_date) AS end_date FROM hist WHERE department = '35'""",
    ("hist",),
)
def resolve_period(t):
    # A custom range without data falls back to the newest year.
    found = views.resolve_period(
        t.hist, "35", mode="custom", start=dt.date(1980, 1, 1), end=dt.date(1980, 2, 1)
    )
    return t.spark.createDataFrame(
        [(found["year"], found["start"], found["end"])], "year int, start_date date, end_date date"
    )


@query(
    "context_view",
    """
    WITH f AS (SELECT * FROM hist WHERE local_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND department = '44')
    SELECT NUM_POSTE, count(*) AS observations, 8784::bigint AS expected, round(100e0 * count(*) / 8784, 8) AS coverage
    FROM f GROUP BY 1
    """,
    ("hist",),
)
def context_view(t):
    chosen = Selection("T", dt.date(2000, 1, 1), dt.date(2000, 12, 31), department="44")
    seen = views.context_view(t.hist, chosen)
    codes = seen["stations"].where("active_in_period").select("NUM_POSTE")
    # One station in this department: its row carries the summary numbers.
    summary = seen["summary"].select("observations", "expected", "coverage")
    joined = summary.withColumn("NUM_POSTE", codes.agg(F.min("NUM_POSTE")).scalar())
    return rounded(joined, "coverage")


@query(
    "validate_selection",
    """SELECT NUM_POSTE FROM (SELECT NUM_POSTE, min(NOM_USUEL) AS n FROM hist WHERE department = '44'
         AND local_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1)""",
    ("hist",),
)
def validate_selection(t):
    chosen = Selection("T", dt.date(2000, 1, 1), dt.date(2000, 12, 31), department="44")
    present = stations.stations_for_period(t.hist, chosen.start, chosen.end, department="44")
    wanted = present.select("NUM_POSTE").unionByName(t.spark.sql("SELECT 'missing' AS NUM_POSTE"))
    return views.valid_stations(t.hist, chosen, wanted)


@query(
    "time_series_view",
    f"""
    WITH best AS ({BEST_STATION.replace("FROM obs", "FROM obs44").strip()})
    SELECT NUM_POSTE, local_date AS observation_date, min(T) AS value, count(T) AS contributing_count
    FROM obs WHERE department = '44' AND T IS NOT NULL AND NUM_POSTE IN (SELECT NUM_POSTE FROM best) GROUP BY ALL
    """.replace("WITH best AS (", "WITH obs44 AS (SELECT * FROM obs WHERE department = '44'), best AS ("),
    ("obs",),
)
def time_series_view(t):
    """The view shows a user's few stations: here the best one of the department."""
    whole = Selection("T", dt.date(2024, 1, 1), dt.date(2024, 1, 31), department="44", statistics=("minimum",))
    best = stations.best_station(t.obs, whole).first().NUM_POSTE
    chosen = Selection(
        "T", whole.start, whole.end, department="44", stations=(best,), statistics=("minimum",)
    )
    series = views.time_series_view(t.obs, chosen, "daily")["series"]
    return series.select("NUM_POSTE", "observation_date", "value", "contributing_count")


@query(
    "historical_view",
    _comparison_sql("T").replace("(QT IS NULL OR QT <> 2)", "T IS NOT NULL"),
    ("hist",),
)
def historical_view(t):
    chosen = Selection("T", dt.date(1999, 11, 1), dt.date(2000, 12, 31))
    return rounded(
        views.historical_view(t.hist, chosen), "selected_average", "average_minimum", "average_maximum"
    )


@query(
    "overview_view",
    f"""WITH {EDGES}, {BOUNDS}, {GRID}, {INSIDE}, {SITES},
        {_nearest_sql('cells', 'lat_index, lon_index')}, {_estimate_sql('lat_index, lon_index')}
        SELECT 'surface' AS layer, LAT, LON, round(temperature, 4) AS temperature
        FROM cells JOIN est USING (lat_index, lon_index) WHERE temperature IS NOT NULL
        UNION ALL SELECT 'stations', LAT, LON, round(period_mean_temperature, 4) FROM means""",
    ("boundaries", "obs"),
)
def overview_view(t):
    chosen = Selection("T", dt.date(2024, 1, 1), dt.date(2024, 1, 31), quality_mode="exclude_doubtful")
    areas = t.view("boundaries")
    layers = views.overview_view(t.obs, chosen, areas, areas.select("code"), 2, STEP)
    means = layers["stations"].select(
        F.lit("stations").alias("layer"), "LAT", "LON", F.col("period_mean_temperature").alias("temperature")
    )
    surface = layers["surface"].select(F.lit("surface").alias("layer"), "LAT", "LON", "temperature")
    return rounded(surface.unionByName(means), "temperature", digits=4)


# ------------------------------------------------------------ sources and sinks
@query(
    "read_boundaries",
    """SELECT code, nom, region, cast(len(polygons) AS int) AS polygons, cast(len(polygons[1]) AS int) AS rings,
              polygons[1][2][3][1] AS third_hole_longitude FROM boundaries""",
    ("boundaries",),
)
def read_boundaries(t):
    """Collections of at most a thousand features each, written as GeoJSON and read back."""
    root = shared_folder(t.spark, "geojson")
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates"))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct("code", "nom", "region").alias("properties"),
        shape.alias("geometry"),
    )
    group = F.floor(F.col("code").cast("bigint") / 1000).alias("part")
    documents = t.view("boundaries").groupBy(group).agg(
        F.to_json(
            F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))
        ).alias("document")
    )
    documents.repartition("part").write.partitionBy("part").text(root)
    rings = F.col("polygons")[0]
    return read_geojson(t.spark, root).select(
        "code", "nom", "region", F.size("polygons").alias("polygons"), F.size(rings).alias("rings"),
        rings[1][2][0].alias("third_hole_longitude"),
    )


@query(
    "read_manifests",
    """SELECT '44' AS department, '2024' AS materialized_years, count(*) AS core_rows,
              count(DISTINCT source_file) AS files FROM station_hours""",
    ("station_hours",),
)
def read_manifests(t):
    from stationlake.sources.manifests import validated_manifests

    return validated_manifests(t.spark, dataset(t)).select(
        "department",
        F.array_join(F.col("materialized_years").cast("array<string>"), ",").alias("materialized_years"),
        "counts.core_rows",
        F.size("source_files").cast("bigint").alias("files"),
    )


@query(
    "write_core_facts",
    f"""SELECT '44' AS folder_department, cast(year({TIME}) AS varchar) AS folder_year, count(*) AS n
        FROM station_hours GROUP BY ALL""",
    ("station_hours",),
)
def write_core_facts(t):
    path = F.col("_metadata.file_path")
    facts = read_table(t.spark, dataset(t), "hourly_core")
    return facts.groupBy(
        F.regexp_extract(path, "department=([^/]+)", 1).alias("folder_department"),
        F.regexp_extract(path, "year=([^/]+)", 1).alias("folder_year"),
    ).agg(F.count("*").alias("n"))


@query(
    "replace_affected_partitions",
    """SELECT department, year, count(*) AS n,
              round(avg(cast(cast(T AS real) + CASE year WHEN 1999 THEN 1 ELSE 0 END AS real)), 3) AS mean
       FROM hist WHERE year <> 2000 GROUP BY ALL""",
    ("hist",),
)
def replace_affected_partitions(t):
    """All years are written; then 1999 is replaced and 2000 comes back empty."""
    root = shared_folder(t.spark, "replace")
    given = t.hist
    facts = given.select(
        *[
            (F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fact_schema("hourly_core").fields
        ]
    )
    codes = [row.department for row in facts.select("department").distinct().collect()]
    replace_fact_partitions(facts, root, "hourly_core", codes[0], [])
    later = facts.where("year = 1999").withColumn("T", (F.col("T") + 1).cast("float"))
    for code in codes:
        replace_fact_partitions(
            later.where(F.col("department") == code), root, "hourly_core", code, [1999, 2000]
        )
    stored = read_table(t.spark, root, "hourly_core")
    return stored.groupBy("department", "year").agg(
        F.count("*").alias("n"), F.round(F.avg("T"), 3).alias("mean")
    )


@query(
    "write_reports",
    f"""WITH {GOOD} SELECT NUM_POSTE AS station_id, count(*) AS observation_count FROM good GROUP BY 1""",
    ("raw",),
)
def write_reports(t):
    folder = shared_folder(t.spark, "reports")
    report = profiling.station_inventory(profiling.station_value_sets(t.raw))
    provenance = report_provenance("explore", t.folder, 15, {})
    path = write_report(report, folder, "station_inventory", provenance)
    return t.spark.read.parquet(path).select("station_id", "observation_count")


@query(
    "export_csv",
    """SELECT department, cast(local_date AS varchar) AS day, cast(min(T) AS varchar) AS lowest
       FROM obs GROUP BY department, local_date""",
    ("obs",),
)
def export(t):
    """A chart-sized table: one row per department and day."""
    folder = shared_folder(t.spark, "export")
    days = t.obs.groupBy("department", F.col("local_date").cast("string").alias("day")).agg(
        F.min("T").alias("lowest")
    )
    chosen = Selection("T", dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    path = export_csv(days, folder, chosen, "daily")
    return t.spark.read.option("header", True).csv(path)

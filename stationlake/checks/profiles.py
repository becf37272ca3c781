"""Checks of archive profiles, audits, reconciliation and resource parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.checks.fixtures import RAW_COLUMNS
from stationlake.checks.registry import plain_times, query, rounded
from stationlake.operators import audits, profiling, reconcile
from stationlake.plans.inspection import exploration_reports
from stationlake.schema import DASHBOARD_COLUMNS, DEPARTMENT_NAMES
from stationlake.sources.archives import select_archives
from stationlake.sources.dictionary import parse_dictionary
from stationlake.sources.resources import parse_resources, select_resources

TIME = "try_strptime(AAAAMMJJHH, '%Y%m%d%H')"
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"
LONG = " UNION ALL ".join(
    f"SELECT source_file, period_start, period_end, source_row_number AS r, '{c}' AS \"column\", "
    f"nullif({c}, '') AS v FROM raw WHERE NOT is_malformed"
    for c in RAW_COLUMNS
)
CORE = ", ".join(f"'{c}'" for c in DASHBOARD_COLUMNS)


def _inventory_sql(condition: str) -> str:
    return f"""
    SELECT source_file, period_start, period_end, count(*) AS row_count,
           count(DISTINCT NUM_POSTE) FILTER (WHERE {condition}) AS station_count,
           {ISO.format(f"min({TIME}) FILTER (WHERE NOT is_malformed)")} AS earliest_timestamp,
           {ISO.format(f"max({TIME}) FILTER (WHERE NOT is_malformed)")} AS latest_timestamp,
           count(*) FILTER (WHERE is_malformed) AS malformed_rows,
           count(*) FILTER (WHERE NOT is_malformed AND {TIME} IS NULL) AS invalid_timestamps
    FROM raw GROUP BY ALL"""


@query("archive_inventory", _inventory_sql("NOT is_malformed"), ("raw",))
def archive_inventory(t):
    return profiling.archive_inventory(t.raw)


@query("exploration_inventory", _inventory_sql(f"NOT is_malformed AND {TIME} IS NOT NULL"), ("raw",))
def exploration_inventory(t):
    return profiling.archive_inventory(t.raw, stations_need_time=True)


@query(
    "schema_groups",
    """
    WITH h AS (SELECT *, substr(sha256(array_to_string(columns, chr(31))), 1, 12) AS schema_id FROM headers)
    SELECT schema_id, array_to_string(any_value(columns), ',') AS columns, count(*) AS file_count,
           arg_min(source_file, (compressed_size, source_file)) AS representative_file,
           min(period_start) AS earliest_period, max(period_end) AS latest_period
    FROM h GROUP BY schema_id
    """,
    ("headers",),
)
def schema_groups(t):
    return profiling.schema_groups(t.view("headers")).withColumn("columns", F.array_join("columns", ","))


@query(
    "smallest_file_per_schema",
    """
    WITH h AS (SELECT *, substr(sha256(array_to_string(columns, chr(31))), 1, 12) AS schema_id FROM headers)
    SELECT schema_id, arg_min(source_file, (compressed_size, source_file)) AS representative_file
    FROM h GROUP BY schema_id
    """,
    ("headers",),
)
def smallest_file_per_schema(t):
    return profiling.schema_groups(t.view("headers")).select("schema_id", "representative_file")


COVERAGE_SQL = """
    c AS (SELECT DISTINCT source_file, unnest(columns) AS "column" FROM headers),
    g AS (SELECT "column", count(*) AS archive_count,
                 round(100e0 * count(*) / (SELECT count(*) FROM headers), 8) AS archive_percentage
          FROM c GROUP BY 1)
    """


@query("column_coverage", f"WITH {COVERAGE_SQL} SELECT * FROM g", ("headers",))
def column_coverage(t):
    return rounded(profiling.column_coverage(t.view("headers")), "archive_percentage")


@query(
    "column_dictionary",
    f"""
    WITH {COVERAGE_SQL},
    d AS (SELECT DISTINCT CASE WHEN p_size > 3 THEN upper(p_type) ELSE concat('SMALL ', p_type) END AS name,
                 concat('type ', p_type) AS description FROM part)
    SELECT g."column", description, description IS NOT NULL AS documented,
           CASE WHEN g."column" LIKE 'Q%' AND substr(g."column", 2) IN (SELECT "column" FROM g)
                THEN substr(g."column", 2) END AS quality_for, archive_count, archive_percentage
    FROM g LEFT JOIN d ON d.name = g."column"
    """,
    ("headers",),
)
def column_dictionary(t):
    name = F.when(F.col("p_size") > 3, F.upper("p_type")).otherwise(F.concat(F.lit("SMALL "), "p_type"))
    official = t.table("part").select(
        name.alias("name"), F.concat(F.lit("type "), "p_type").alias("description")
    ).distinct()
    result = profiling.column_dictionary(profiling.column_coverage(t.view("headers")), official)
    return rounded(result, "archive_percentage")


STATS = f"""
    long AS ({LONG}),
    vc AS (SELECT source_file, period_start, period_end, "column", v, count(*) AS n, min(r) AS r
           FROM long GROUP BY ALL),
    st AS (SELECT source_file, period_start, period_end, "column", cast(sum(n) AS bigint) AS valid,
                  cast(coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) AS bigint) AS populated_count,
                  count(v) AS distinct_values,
                  cast(coalesce(sum(n) FILTER (WHERE try_cast(v AS double) IS NOT NULL), 0) AS bigint) AS num,
                  min(try_cast(v AS double)) AS numeric_min, max(try_cast(v AS double)) AS numeric_max
           FROM vc GROUP BY ALL),
    ex AS (SELECT source_file, "column", cast(to_json(list(v ORDER BY r)) AS varchar) AS examples
           FROM (SELECT *, row_number() OVER (PARTITION BY source_file, "column" ORDER BY r) AS place
                 FROM vc WHERE v IS NOT NULL) WHERE place <= 3 GROUP BY ALL)
    """


@query(
    "column_profile",
    f"""
    WITH {STATS}
    SELECT st.source_file, period_start, period_end, st."column", populated_count,
           valid - populated_count AS null_count, round(100e0 * populated_count / valid, 8) AS coverage_percentage,
           CASE WHEN populated_count > 0 AND num = populated_count THEN 'numeric' ELSE 'string' END AS inferred_type,
           numeric_min, numeric_max, coalesce(examples, '[]') AS examples,
           st."column" IN ({CORE}) AS is_core_dashboard_field
    FROM st LEFT JOIN ex ON ex.source_file = st.source_file AND ex."column" = st."column"
    """,
    ("raw",),
)
def column_profile(t):
    return rounded(profiling.column_profile(t.raw), "coverage_percentage")


@query(
    "first_n_examples",
    f"""
    WITH {STATS}
    SELECT source_file, "column", v AS value, place FROM (
      SELECT *, cast(row_number() OVER (PARTITION BY source_file, "column" ORDER BY r) AS int) AS place
      FROM vc WHERE v IS NOT NULL) WHERE place <= 3
    """,
    ("raw",),
)
def first_n_examples(t):
    examples = profiling.first_examples(profiling.column_summaries(t.raw))
    return examples.select("source_file", "column", "value", "place")


@query(
    "archive_profile",
    f"""
    WITH {STATS},
    dup AS (SELECT source_file, cast(sum(c - 1) AS bigint) AS d FROM
            (SELECT source_file, NUM_POSTE, AAAAMMJJHH, count(*) AS c FROM raw WHERE NOT is_malformed GROUP BY ALL)
            GROUP BY 1)
    SELECT st.source_file AS filename, st."column",
           CASE WHEN populated_count > 0 AND num = populated_count THEN 'numeric' ELSE 'string' END AS inferred_type,
           populated_count, distinct_values AS distinct_count,
           coalesce(examples, '[]') AS examples, numeric_min, numeric_max, d AS duplicate_station_timestamp_count
    FROM st LEFT JOIN ex ON ex.source_file = st.source_file AND ex."column" = st."column"
    JOIN dup ON dup.source_file = st.source_file
    """,
    ("raw",),
)
def archive_profile(t):
    return profiling.archive_profile(t.raw)


@query(
    "quality_code_profile",
    f"""
    WITH long AS ({LONG})
    SELECT source_file, "column", v AS value, count(*) AS count,
           round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY source_file, "column"), 8)
             AS percentage_of_populated
    FROM long WHERE v IS NOT NULL AND "column" LIKE 'Q%' GROUP BY source_file, "column", v
    """,
    ("raw",),
)
def quality_code_profile(t):
    return rounded(profiling.quality_code_profile(t.raw), "percentage_of_populated")


def _json_list(column: str) -> str:
    return f"cast(to_json(list_sort(list(DISTINCT {column}))) AS varchar)"


GOOD = f"good AS (SELECT *, {TIME} AS ts FROM raw WHERE NOT is_malformed AND {TIME} IS NOT NULL)"


@query(
    "station_inventory",
    f"""
    WITH {GOOD}
    SELECT NUM_POSTE AS station_id, {_json_list('NOM_USUEL')} AS names, {_json_list('LAT')} AS latitudes,
           {_json_list('LON')} AS longitudes, {_json_list('ALTI')} AS altitudes,
           strftime(min(ts), '%Y%m%d%H') AS first_timestamp_utc, strftime(max(ts), '%Y%m%d%H') AS last_timestamp_utc,
           count(*) AS observation_count, count(*) FILTER (WHERE T <> '') AS temperature_count,
           {_json_list('source_file')} AS source_files
    FROM good GROUP BY 1
    """,
    ("raw",),
)
def station_inventory(t):
    return profiling.station_inventory(profiling.station_value_sets(t.raw))


CONFLICTS = " UNION ALL ".join(
    f"SELECT NUM_POSTE AS station_id, '{label}' AS field, {_json_list(column)} AS \"values\", "
    f"cast(count(DISTINCT {column}) AS int) AS value_count FROM good GROUP BY 1 HAVING count(DISTINCT {column}) > 1"
    for column, label in (("NOM_USUEL", "name"), ("LAT", "latitude"), ("LON", "longitude"), ("ALTI", "altitude"))
)


@query("metadata_conflicts", f"WITH {GOOD} {CONFLICTS}", ("raw",))
def metadata_conflicts(t):
    return profiling.metadata_conflicts(profiling.station_value_sets(t.raw))


@query(
    "station_year_coverage",
    f"""
    WITH {GOOD}
    SELECT NUM_POSTE AS station_id, cast(year(ts) AS int) AS year, count(*) AS observation_count,
           count(*) FILTER (WHERE T <> '') AS temperature_count, 8784 AS expected_hours,
           round(100e0 * count(*) FILTER (WHERE T <> '') / 8784, 8) AS temperature_coverage_percentage,
           count(*) FILTER (WHERE T <> '') >= 8784 * 9e-1 AS has_90_percent_temperature_coverage
    FROM good GROUP BY ALL
    """,
    ("raw",),
)
def station_year_coverage(t):
    return rounded(profiling.station_year_coverage(t.raw), "temperature_coverage_percentage")


DUPLICATES = f"""
    WITH {GOOD}
    SELECT NUM_POSTE AS station_id, AAAAMMJJHH AS "timestamp", count(*) AS record_count,
           count(DISTINCT source_file) AS source_file_count,
           array_to_string(list_sort(list(DISTINCT source_file)), ',') AS source_files
    FROM good GROUP BY ALL HAVING count(*) > 1
    """


@query("duplicate_observations", DUPLICATES, ("raw",))
def duplicate_observations(t):
    return profiling.duplicate_observations(t.raw).withColumn("source_files", F.array_join("source_files", ","))


@query("archive_overlaps", DUPLICATES + " AND count(DISTINCT source_file) > 1", ("raw",))
def archive_overlaps(t):
    overlaps = profiling.archive_overlaps(profiling.duplicate_observations(t.raw))
    return overlaps.withColumn("source_files", F.array_join("source_files", ","))


@query(
    "exploration_summary",
    f"""
    WITH {GOOD}, dup AS ({DUPLICATES.split('WITH ' + GOOD)[1]}), conflicts AS ({CONFLICTS})
    SELECT (SELECT count(DISTINCT source_file) FROM raw) AS archives,
           (SELECT count(DISTINCT NUM_POSTE) FROM good) AS stations, 0::bigint AS errors,
           (SELECT count(*) FROM dup) AS duplicates,
           (SELECT count(*) FROM dup WHERE source_file_count > 1) AS cross_archive_overlaps,
           (SELECT count(*) FROM (SELECT NUM_POSTE FROM good GROUP BY NUM_POSTE, year(ts)
             HAVING count(*) FILTER (WHERE T <> '') >= 8784 * 9e-1)) AS station_years_with_90_percent_temperature,
           (SELECT count(*) FROM conflicts) AS metadata_conflicts
    """,
    ("raw",),
)
def exploration_summary(t):
    reports = exploration_reports(t.raw)
    return profiling.exploration_summary(
        reports["archive_inventory"], reports["station_inventory"], reports["duplicate_observations"],
        reports["station_year_temperature_coverage"], reports["station_metadata_conflicts"],
    )


@query(
    "duplicate_station_hours",
    """SELECT network_category, NUM_POSTE, observation_time_utc, count(*) AS copies
       FROM hist GROUP BY ALL HAVING count(*) > 1""",
    ("hist",),
)
def duplicate_station_hours(t):
    return plain_times(audits.duplicate_station_hours(t.hist))


# ------------------------------------------------------------------- audits
@query(
    "diff_sources",
    """
    SELECT coalesce(n.department, b.department) AS department, coalesce(n.filename, b.filename) AS filename,
           CASE WHEN n.filename IS NULL THEN 'removed' WHEN b.filename IS NULL THEN 'new'
                WHEN n.sha256 <> b.sha256 THEN 'changed' ELSE 'unchanged' END AS change,
           cast(coalesce(n.period_start, b.period_start) AS int) AS period_start,
           cast(coalesce(n.period_end, b.period_end) AS int) AS period_end
    FROM files_now n FULL JOIN files_before b ON n.department = b.department AND n.filename = b.filename
    """,
    ("files_now", "files_before"),
)
def diff_sources(t):
    return audits.diff_sources(t.view("files_now"), t.view("files_before"))


@query(
    "audit_reference_integrity",
    """
    WITH e AS (SELECT DISTINCT department, filename FROM files_now),
    o AS (SELECT department, filename, count(*) AS found FROM
          (SELECT department, filename FROM files_before
           UNION ALL SELECT department, filename FROM files_before WHERE size % 2 = 0) GROUP BY ALL)
    SELECT coalesce(e.department, o.department) AS department, coalesce(e.filename, o.filename) AS filename,
           CASE WHEN o.filename IS NULL THEN 'missing' WHEN e.filename IS NULL THEN 'unexpected' ELSE 'duplicate' END
             AS issue, coalesce(found, 0) AS found
    FROM e FULL JOIN o ON e.department = o.department AND e.filename = o.filename
    WHERE e.filename IS NULL OR o.filename IS NULL OR found > 1
    """,
    ("files_now", "files_before"),
)
def audit_reference_integrity(t):
    before = t.view("files_before")
    observed = before.unionByName(before.where("size % 2 = 0"))
    return audits.compare_keys(t.view("files_now"), observed, ["department", "filename"])


@query(
    "stations_for_new_facts",
    """SELECT department, year, count(*) AS n FROM (
         SELECT department, year FROM hist WHERE year NOT IN (1998, 1999)
         UNION ALL SELECT department, year FROM obs) GROUP BY ALL""",
    ("hist", "obs"),
)
def stations_for_new_facts(t):
    affected = t.hist.where("year in (1998, 1999)").select("department", "year").distinct()
    facts = audits.facts_for_dimensions(t.hist, t.obs.drop("event_id"), affected)
    return facts.groupBy("department", "year").agg(F.count("*").alias("n"))


@query(
    "set_difference",
    """SELECT DISTINCT filename FROM files_now WHERE filename NOT IN (SELECT filename FROM files_before)""",
    ("files_now", "files_before"),
)
def set_difference(t):
    return audits.set_difference(t.view("files_now"), t.view("files_before"), "filename")


STATUS_SQL = """
    ch AS (SELECT coalesce(n.department, b.department) AS department, coalesce(n.period_start, b.period_start) AS a,
                  coalesce(n.period_end, b.period_end) AS z,
                  CASE WHEN n.filename IS NULL THEN 'removed' WHEN b.filename IS NULL THEN 'new'
                       WHEN n.sha256 <> b.sha256 THEN 'changed' ELSE 'unchanged' END AS change
           FROM files_now n FULL JOIN files_before b ON n.department = b.department AND n.filename = b.filename),
    m AS (SELECT DISTINCT department, 1 AS dataset_version, CASE department WHEN '35' THEN '0.9.0' ELSE '1.0.1' END
                 AS transformation_version FROM files_before
          UNION ALL SELECT '62', 1, '1.0.1'),
    y AS (SELECT department, array_to_string(list_sort(list(DISTINCT v)), ',') AS affected_years
          FROM (SELECT department, unnest(range(a, z + 1)) AS v FROM ch WHERE change <> 'unchanged') GROUP BY 1),
    c AS (SELECT department, count(*) FILTER (WHERE change <> 'removed') AS s,
                 count(*) FILTER (WHERE change IN ('new', 'changed')) AS g,
                 count(*) FILTER (WHERE change = 'removed') AS r FROM ch GROUP BY 1),
    st AS (SELECT m.department, CASE WHEN m.department NOT IN (SELECT department FROM files_now) THEN 'error'
                  WHEN transformation_version <> '1.0.1' THEN 'rebuild' WHEN g > 0 OR r > 0 THEN 'pending'
                  ELSE 'up-to-date' END AS status, coalesce(s, 0) AS source_archives,
                  coalesce(g, 0) AS changed_archives, coalesce(r, 0) AS removed_archives,
                  coalesce(affected_years, '') AS affected_years,
                  CASE WHEN m.department NOT IN (SELECT department FROM files_now)
                       THEN concat('No verified local hourly archives found for department ', m.department) END AS error
           FROM m LEFT JOIN c USING (department) LEFT JOIN y USING (department))
    """


def _status(t):
    before = t.view("files_before")
    version = F.when(F.col("department") == "35", "0.9.0").otherwise("1.0.1")
    manifests = before.select("department").distinct().unionByName(
        before.agg(F.lit("62").alias("department"))
    ).withColumns({"dataset_version": F.lit(1), "transformation_version": version})
    now = t.view("files_now")
    return audits.dataset_status(manifests, now, audits.diff_sources(now, before))


@query("dataset_status", f"WITH {STATUS_SQL} SELECT * FROM st", ("files_now", "files_before"))
def dataset_status(t):
    return _status(t).withColumn(
        "affected_years", F.array_join(F.col("affected_years").cast("array<string>"), ",")
    )


@query(
    "dataset_status_counts",
    f"WITH {STATUS_SQL} SELECT status, count(*) AS departments FROM st GROUP BY 1",
    ("files_now", "files_before"),
)
def dataset_status_counts(t):
    return audits.status_counts(_status(t))


@query(
    "raw_only_departments",
    """SELECT DISTINCT department FROM files_now WHERE department NOT IN
       (SELECT CASE WHEN period_start > 2005 THEN department ELSE 'raw only' END FROM files_before)""",
    ("files_now", "files_before"),
)
def raw_only_departments(t):
    kept = F.when(F.col("period_start") > 2005, F.col("department")).otherwise("raw only")
    materialised = t.view("files_before").withColumn("department", kept)
    return audits.raw_only_departments(t.view("files_now"), materialised)


def _names_case(column: str) -> str:
    branches = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in DEPARTMENT_NAMES.items())
    return f"CASE {column} {branches} END"


@query(
    "source_metadata_tables",
    f"""
    SELECT filename, department, period_start, period_end, size, mtime_ns, sha256, 'main' AS network_category,
           {_names_case('department')} AS department_name FROM files_before
    """,
    ("files_before",),
)
def source_metadata_tables(t):
    before = t.view("files_before")
    names = audits.department_rows(before.select("department")).select("department", "department_name")
    return audits.source_file_rows(before).join(names, "department")


# ------------------------------------------------------- catalog and files
@query(
    "parse_resource_catalog",
    r"""
    WITH f AS (SELECT *, replace(regexp_extract(url, '[^/]+$', 0), '%20', ' ') AS filename FROM resources
               WHERE type <> 'documentation'),
    x AS (SELECT *, concat(coalesce(title, ''), ' ', filename) AS txt FROM f)
    SELECT id AS resource_id, title, url, format, last_modified, filesize AS expected_size, filename,
           upper(coalesce(nullif(regexp_extract(txt, 'departement[_\s-]*(2A|2B|[0-9]{2,3})', 1, 'i'), ''),
                          nullif(regexp_extract(txt, 'horaires?[_\s-]+(2A|2B|[0-9]{2,3})[_\s-]', 1, 'i'), ''),
                          nullif(regexp_extract(txt, '(?:^|\s)H[_\s-]+(2A|2B|[0-9]{2,3})[_\s-]', 1, 'i'), '')))
             AS department,
           cast(coalesce(nullif(regexp_extract(txt, 'p[ée]riode[_\s-]*([0-9]{4})[_\s-]+([0-9]{4})', 1, 'i'), ''),
                nullif(regexp_extract(txt, 'd[ée]cennie[_\s-]*([0-9]{4})[_\s-]+([0-9]{4})', 1, 'i'), ''),
                nullif(regexp_extract(txt, '(?:^|[_\s-])([0-9]{4})[_\s-]+([0-9]{4})(?:[^0-9]|$)', 1, 'i'), '')) AS int)
             AS period_start,
           cast(coalesce(nullif(regexp_extract(txt, 'p[ée]riode[_\s-]*([0-9]{4})[_\s-]+([0-9]{4})', 2, 'i'), ''),
                nullif(regexp_extract(txt, 'd[ée]cennie[_\s-]*([0-9]{4})[_\s-]+([0-9]{4})', 2, 'i'), ''),
                nullif(regexp_extract(txt, '(?:^|[_\s-])([0-9]{4})[_\s-]+([0-9]{4})(?:[^0-9]|$)', 2, 'i'), '')) AS int)
             AS period_end
    FROM x
    """,
    ("resources",),
)
def parse_resource_catalog(t):
    return parse_resources(t.view("resources"))


@query(
    "select_resources",
    r"""
    WITH x AS (SELECT id AS resource_id, concat(coalesce(title, ''), ' ',
                      replace(regexp_extract(url, '[^/]+$', 0), '%20', ' ')) AS txt
               FROM resources WHERE type <> 'documentation'),
    p AS (SELECT resource_id,
           cast(coalesce(nullif(regexp_extract(txt, 'p[ée]riode[_\s-]*([0-9]{4})[_\s-]+([0-9]{4})', 1, 'i'), ''),
                nullif(regexp_extract(txt, 'd[ée]cennie[_\s-]*([0-9]{4})[_\s-]+([0-9]{4})', 1, 'i'), ''),
                nullif(regexp_extract(txt, '(?:^|[_\s-])([0-9]{4})[_\s-]+([0-9]{4})(?:[^0-9]|$)', 1, 'i'), '')) AS int) AS a,
           cast(coalesce(nullif(regexp_extract(txt, 'p[ée]riode[_\s-]*([0-9]{4})[_\s-]+([0-9]{4})', 2, 'i'), ''),
                nullif(regexp_extract(txt, 'd[ée]cennie[_\s-]*([0-9]{4})[_\s-]+([0-9]{4})', 2, 'i'), ''),
                nullif(regexp_extract(txt, '(?:^|[_\s-])([0-9]{4})[_\s-]+([0-9]{4})(?:[^0-9]|$)', 2, 'i'), '')) AS int) AS b
          FROM x)
    SELECT resource_id, a AS period_start, b AS period_end FROM p WHERE b >= 1970 AND a <= 1985
    """,
    ("resources",),
)
def select_catalog_resources(t):
    chosen = select_resources(parse_resources(t.view("resources")), None, 1970, 1985)
    return chosen.select("resource_id", "period_start", "period_end")


@query(
    "discover_archives",
    """SELECT DISTINCT source_file AS filename, split_part(source_file, '_', 2) AS department, period_start, period_end
       FROM raw WHERE period_start <= 2023""",
    ("raw",),
)
def discover_archives(t):
    listing = t.raw.select(F.col("source_file").alias("filename")).distinct()
    return select_archives(listing, None, None, 2023)


@query(
    "read_metric_dictionary",
    """
    WITH l AS (SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN p_name WHEN p_size % 6 = 1 THEN concat(p_name, ' : x')
                      ELSE concat(upper(p_type), ' : ', p_name, ' : ', p_brand, ' ') END AS line FROM part),
    e AS (SELECT p_partkey, trim(split_part(line, ':', 1)) AS name,
                 trim(substr(line, strpos(line, ':') + 1)) AS description FROM l WHERE contains(line, ':'))
    SELECT name, arg_max(description, p_partkey) AS description FROM e
    WHERE name <> '' AND NOT contains(name, ' ') GROUP BY 1
    """,
)
def read_metric_dictionary(t):
    size = F.col("p_size") % 6
    line = (
        F.when(size == 0, F.col("p_name"))
        .when(size == 1, F.concat("p_name", F.lit(" : x")))
        .otherwise(F.concat(F.upper("p_type"), F.lit(" : "), "p_name", F.lit(" : "), "p_brand", F.lit(" ")))
    )
    return parse_dictionary(t.table("part").select(F.col("p_partkey").alias("line_number"), line.alias("line")))


RECONCILED = """
    j AS (SELECT c.filename, c.expected_size, l.size AS local_size, p.size AS partial_size,
                 CASE WHEN l.size <> c.expected_size THEN s.server_size END AS server_size, s.remote_error AS e
          FROM catalog_files c LEFT JOIN local_files l ON l.filename = c.filename
          LEFT JOIN partial_files p ON p.filename = c.filename
          LEFT JOIN server_sizes s ON s.filename = c.filename),
    r AS (SELECT *, CASE WHEN local_size IS NULL AND partial_size IS NOT NULL THEN 'partial'
                         WHEN local_size IS NULL THEN 'missing' WHEN expected_size IS NULL THEN 'unknown-size'
                         WHEN local_size = expected_size THEN 'complete' WHEN local_size = server_size THEN 'complete'
                         ELSE 'invalid' END AS status,
                 coalesce(local_size <> expected_size, false) AS differs FROM j),
    f AS (SELECT filename, expected_size, local_size, partial_size, status, server_size,
                 CASE WHEN local_size IS NULL OR expected_size IS NULL THEN 'unavailable'
                      WHEN differs AND server_size IS NOT NULL THEN 'server' ELSE 'catalog' END AS size_source,
                 differs AND (server_size IS NULL OR server_size <> expected_size) AS catalog_mismatch,
                 CASE WHEN differs AND server_size IS NULL
                      THEN coalesce(e, 'HEAD response did not include a usable Content-Length') END AS remote_error,
                 status IN ('complete', 'unknown-size') AND coalesce(partial_size = local_size, false)
                   AS redundant_partial FROM r)
    """
FILE_VIEWS = ("catalog_files", "local_files", "partial_files", "server_sizes")


def _reconciled(t):
    catalog, *others = (t.view(name) for name in FILE_VIEWS)
    return reconcile.reconcile_files(catalog.drop("p_partkey"), *others)


@query("reconcile_files", f"WITH {RECONCILED} SELECT * FROM f", FILE_VIEWS)
def reconcile_files(t):
    return _reconciled(t)


@query("reconcile_status", f"WITH {RECONCILED} SELECT filename, status FROM f", FILE_VIEWS)
def reconcile_status(t):
    return _reconciled(t).select("filename", "status")


@query(
    "archive_status_summary",
    f"""
    WITH {RECONCILED}
    SELECT count(*) AS selected_resources, cast(coalesce(sum(expected_size), 0) AS bigint) AS known_expected_size,
           count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'missing') AS missing,
           count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'invalid') AS invalid,
           count(*) FILTER (WHERE status = 'unknown-size') AS unknown_size,
           count(*) FILTER (WHERE catalog_mismatch) AS size_discrepancies,
           count(*) FILTER (WHERE redundant_partial) AS redundant_partials FROM f
    """,
    FILE_VIEWS,
)
def archive_status_summary(t):
    return reconcile.archive_status_summary(_reconciled(t))

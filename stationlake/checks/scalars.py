"""Checks of scalar rules: values, names, civil time, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.checks.registry import plain_times, query, rounded
from stationlake.functions import timeops, values
from stationlake.functions.spatial import haversine_km
from stationlake.operators import audits, ingest, metrics, profiling
from stationlake.schema import DEPARTMENT_NAMES, EXTENSION_TABLES, KNOWN_CODE_COLUMNS, METRIC_LABELS

PARIS_OF = "(({0} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris')"
OBS_PARIS = PARIS_OF.format("observation_time_utc")
OFFSET = f"date_diff('second', observation_time_utc, {OBS_PARIS})"


@query(
    "convert_metric_value",
    """
    WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber,
                      CASE WHEN l_linenumber = 1 THEN '' ELSE cast(l_extendedprice AS varchar) END AS raw
               FROM lineitem),
    n AS (SELECT *, try_cast(nullif(raw, '') AS double) AS v FROM t)
    SELECT l_orderkey, l_partkey, l_linenumber,
           CASE WHEN trunc(v) BETWEEN 0 AND 65535 THEN cast(trunc(v) AS int) END AS whole_value,
           cast(cast(v AS real) AS double) AS decimal_value,
           coalesce(v IS NOT NULL AND NOT trunc(v) BETWEEN 0 AND 65535, false) AS is_bad
    FROM n
    """,
)
def convert_metric_value(t):
    text = F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_extendedprice").cast("string"))
    return t.table("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        values.convert_metric(text, "DD").alias("whole_value"),
        values.convert_metric(text, "T").cast("double").alias("decimal_value"),
        values.is_bad_metric(text, "DD").alias("is_bad"),
    )


@query(
    "parse_observation_time",
    """SELECT source_file, source_row_number, try_strptime(AAAAMMJJHH, '%Y%m%d%H') AS observation_time_utc
       FROM raw""",
    ("raw",),
)
def parse_observation_time(t):
    return plain_times(
        t.raw.select(
            "source_file", "source_row_number",
            timeops.parse_observation_time(F.col("AAAAMMJJHH")).alias("observation_time_utc"),
        )
    )


@query(
    "valid_timestamp_flag",
    """SELECT source_file, try_strptime(AAAAMMJJHH, '%Y%m%d%H') IS NOT NULL AS is_valid, count(*) AS n
       FROM raw GROUP BY ALL""",
    ("raw",),
)
def valid_timestamp_flag(t):
    valid = timeops.is_valid_time(F.col("AAAAMMJJHH")).alias("is_valid")
    return t.raw.groupBy("source_file", valid).agg(F.count("*").alias("n"))


@query(
    "local_civil_time",
    f"""SELECT o_orderkey, {OBS_PARIS} AS local_time, cast({OBS_PARIS} AS date) AS local_day,
               cast(extract(hour FROM {OBS_PARIS}) AS smallint) AS hour_of_day FROM hist""",
    ("hist",),
)
def local_civil_time(t):
    instant = F.col("observation_time_utc")
    return t.hist.select(
        "o_orderkey",
        timeops.local_wall_clock(instant).alias("local_time"),
        timeops.local_date(instant).alias("local_day"),
        timeops.local_hour(instant).alias("hour_of_day"),
    )


@query(
    "utc_offset_minutes",
    f"SELECT o_orderkey, cast(trunc({OFFSET} / 6e1) AS smallint) AS utc_offset_minutes FROM hist",
    ("hist",),
)
def utc_offset_minutes(t):
    offset = timeops.utc_offset_minutes(F.col("observation_time_utc"))
    return t.hist.select("o_orderkey", offset.alias("utc_offset_minutes"))


@query("is_dst", f"SELECT o_orderkey, {OFFSET} = 7200 AS is_dst FROM hist", ("hist",))
def is_dst(t):
    return t.hist.select("o_orderkey", timeops.is_dst(F.col("observation_time_utc")).alias("is_dst"))


_PARSED = "try_strptime(AAAAMMJJHH, '%Y%m%d%H')"


@query(
    "require_identity",
    f"""
    WITH checked AS (
      SELECT source_file, source_row_number,
             CASE WHEN is_malformed THEN 'wrong number of fields'
                  WHEN NUM_POSTE = '' THEN 'missing required NUM_POSTE'
                  WHEN NOM_USUEL = '' THEN 'missing required NOM_USUEL'
                  WHEN LAT = '' THEN 'missing required LAT'
                  WHEN LON = '' THEN 'missing required LON'
                  WHEN ALTI = '' THEN 'missing required ALTI'
                  WHEN AAAAMMJJHH = '' THEN 'missing required AAAAMMJJHH'
                  WHEN {_PARSED} IS NULL THEN concat('invalid AAAAMMJJHH=', AAAAMMJJHH)
                  WHEN RR1 <> '' AND try_cast(RR1 AS double) IS NULL THEN concat('invalid RR1=', RR1)
                  WHEN T <> '' AND try_cast(T AS double) IS NULL THEN concat('invalid T=', T) END AS problem
      FROM raw)
    SELECT * FROM checked WHERE problem IS NOT NULL
    """,
    ("raw",),
)
def require_identity(t):
    return ingest.row_problems(t.raw)


def _with_extensions(rows):
    number = F.col("source_row_number")
    return rows.withColumns(
        {
            "T10": F.when(number % 5 == 0, F.col("QRR1")).otherwise(""),
            "TMER": F.when(number % 7 == 0, F.col("QRR1")).otherwise(""),
            "NEIGETOT": F.when(number % 11 == 0, F.col("QRR1")).otherwise(""),
            "department": values.archive_department(F.col("source_file")),
            "source_sha256": F.sha2("source_file", 256),
        }
    )


@query(
    "split_fact_tables",
    f"""
    WITH good AS (SELECT * FROM raw WHERE NOT is_malformed AND {_PARSED} IS NOT NULL)
    SELECT 'hourly_core' AS table_name, source_file, source_row_number FROM good
    UNION ALL SELECT 'hourly_surface', source_file, source_row_number FROM good
              WHERE source_row_number % 5 = 0 AND QRR1 <> ''
    UNION ALL SELECT 'hourly_marine', source_file, source_row_number FROM good
              WHERE source_row_number % 7 = 0 AND QRR1 <> ''
    UNION ALL SELECT 'hourly_snow', source_file, source_row_number FROM good
              WHERE source_row_number % 11 = 0 AND QRR1 <> ''
    """,
    ("raw",),
)
def split_fact_tables(t):
    rows = _with_extensions(profiling.timed_rows(t.raw))
    tables = ["hourly_core", *EXTENSION_TABLES]
    parts = [
        ingest.typed_facts(rows, table, "check").select(
            F.lit(table).alias("table_name"), "source_file", "source_row_number"
        )
        for table in tables
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "constant_lineage",
    f"""SELECT source_file, source_row_number, 'main' AS network_category, 'run-1' AS processing_run_id,
               sha256(source_file) AS source_sha256, split_part(source_file, '_', 2) AS department
        FROM raw WHERE NOT is_malformed AND {_PARSED} IS NOT NULL""",
    ("raw",),
)
def constant_lineage(t):
    facts = ingest.typed_facts(_with_extensions(profiling.timed_rows(t.raw)), "hourly_core", "run-1")
    return facts.select(
        "source_file", "source_row_number", "network_category", "processing_run_id", "source_sha256",
        "department",
    )


@query(
    "ingestion_counts",
    f"""
    WITH good AS (SELECT * FROM raw WHERE NOT is_malformed AND {_PARSED} IS NOT NULL)
    SELECT count(*) AS source_rows, count(*) AS core_rows,
           count(*) FILTER (WHERE source_row_number % 5 = 0 AND QRR1 <> '') AS hourly_surface,
           count(*) FILTER (WHERE source_row_number % 7 = 0 AND QRR1 <> '') AS hourly_marine,
           count(*) FILTER (WHERE source_row_number % 11 = 0 AND QRR1 <> '') AS hourly_snow
    FROM good
    """,
    ("raw",),
)
def ingestion_counts(t):
    return ingest.ingestion_counts(_with_extensions(profiling.timed_rows(t.raw)))


@query(
    "day_expression",
    f"""SELECT event_id, cast({OBS_PARIS} AS date) AS local_day, cast(observation_time_utc AS date) AS utc_day
        FROM obs""",
    ("obs",),
)
def day_expression(t):
    return t.obs.select(
        "event_id", timeops.day_of("local").alias("local_day"), timeops.day_of("utc").alias("utc_day")
    )


@query(
    "hour_expression",
    f"""SELECT event_id, cast(extract(hour FROM {OBS_PARIS}) AS smallint) AS local_clock_hour,
               cast(extract(hour FROM observation_time_utc) AS smallint) AS utc_clock_hour FROM obs""",
    ("obs",),
)
def hour_expression(t):
    return t.obs.select(
        "event_id",
        timeops.hour_of("local").alias("local_clock_hour"),
        timeops.hour_of("utc").alias("utc_clock_hour"),
    )


@query(
    "wall_clock_time",
    f"SELECT event_id, {OBS_PARIS} AS local_clock, observation_time_utc AS utc_clock FROM obs",
    ("obs",),
)
def wall_clock_time(t):
    return t.obs.select(
        "event_id",
        timeops.wall_clock_of("local").alias("local_clock"),
        timeops.wall_clock_of("utc").alias("utc_clock"),
    )


@query(
    "month_day",
    "SELECT strftime(local_date, '%m-%d') AS month_day, count(*) AS n FROM hist GROUP BY ALL",
    ("hist",),
)
def month_day(t):
    key = timeops.month_day(F.col("local_date")).alias("month_day")
    return t.hist.groupBy(key).agg(F.count("*").alias("n"))


@query(
    "expected_hours",
    """
    WITH r AS (SELECT o_orderkey, local_date AS a, local_date + cast(o_orderkey % 40 AS int) AS b FROM hist)
    SELECT o_orderkey, cast((b - a + 1) * 24 AS bigint) AS utc_hours,
           cast((epoch(timezone('Europe/Paris', cast(b + 1 AS timestamp)))
                 - epoch(timezone('Europe/Paris', cast(a AS timestamp)))) / 3600 AS bigint) AS local_hours
    FROM r
    """,
    ("hist",),
)
def expected_hours(t):
    start = F.col("local_date")
    end = F.date_add(start, (F.col("o_orderkey") % 40).cast("int"))
    return t.hist.select(
        "o_orderkey",
        timeops.expected_hours(start, end, "utc").alias("utc_hours"),
        timeops.expected_hours(start, end, "local").alias("local_hours"),
    )


@query(
    "expected_year_hours",
    """SELECT year, CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0) THEN 8784 ELSE 8760 END
              AS expected_hours, count(*) AS n FROM hist GROUP BY ALL""",
    ("hist",),
)
def expected_year_hours(t):
    expected = timeops.expected_year_hours(F.col("year")).alias("expected_hours")
    return t.hist.groupBy("year", expected).agg(F.count("*").alias("n"))


@query(
    "coverage_percentage",
    """SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN round(1e2 * p_retailprice / (p_size % 5 * 400), 8) ELSE 0e0 END
              AS plain_percentage,
              CASE WHEN p_size % 5 > 0 THEN round(least(1e2, 1e2 * p_retailprice / (p_size % 5 * 400)), 8)
                   ELSE 0e0 END AS capped FROM part""",
)
def coverage_percentage(t):
    whole = F.col("p_size") % 5 * 400
    frame = t.table("part").select(
        "p_partkey",
        values.percentage(F.col("p_retailprice"), whole).alias("plain_percentage"),
        values.capped_percentage(F.col("p_retailprice"), whole).alias("capped"),
    )
    return rounded(frame, "plain_percentage", "capped")


@query(
    "official_unit",
    r"""
    WITH d AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name
                      WHEN 1 THEN concat(p_name, ' (en ', p_type, ' )') ELSE concat(p_name, ' (EN °', p_brand, ')')
                      END AS description FROM part)
    SELECT p_partkey, nullif(trim(regexp_extract(description, '\(en ([^)]+)\)', 1, 'i')), '') AS unit FROM d
    """,
)
def official_unit(t):
    size, name = F.col("p_size") % 3, F.col("p_name")
    description = (
        F.when(size == 0, name)
        .when(size == 1, F.concat(name, F.lit(" (en "), "p_type", F.lit(" )")))
        .otherwise(F.concat(name, F.lit(" (EN °"), "p_brand", F.lit(")")))
    )
    return t.table("part").select("p_partkey", values.official_unit(description).alias("unit"))


_NAME = "CASE WHEN source_row_number % 5 = 0 THEN concat(source_file, '.part') ELSE source_file END"
_PATTERN = r"^H_(2A|2B|[0-9]{2,3})_(?:(?:latest|previous)-)?([0-9]{4})-([0-9]{4})\.csv\.gz$"


@query(
    "archive_name_parts",
    f"""
    WITH n AS (SELECT source_row_number, {_NAME} AS name FROM raw)
    SELECT source_row_number, name, nullif(regexp_extract(name, '{_PATTERN}', 1), '') AS department,
           cast(nullif(regexp_extract(name, '{_PATTERN}', 2), '') AS int) AS first_year,
           cast(nullif(regexp_extract(name, '{_PATTERN}', 3), '') AS int) AS last_year FROM n
    """,
    ("raw",),
)
def archive_name_parts(t):
    name = F.expr(_NAME)
    return t.raw.select(
        "source_row_number",
        name.alias("name"),
        values.archive_department(name).alias("department"),
        values.archive_start(name).alias("first_year"),
        values.archive_end(name).alias("last_year"),
    )


_CODE = (
    "CASE c_custkey % 7 WHEN 0 THEN '2A' WHEN 1 THEN '2B' WHEN 2 THEN 'XX' "
    "ELSE lpad(cast(c_custkey % 999 AS varchar(20)), 2, '0') END"
)


@query(
    "is_metropolitan",
    f"""
    WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 999 >= 100 AND c_custkey % 7 > 2
                      THEN cast(c_custkey % 999 AS varchar) ELSE {_CODE} END AS code FROM customer)
    SELECT c_custkey, code, code IN ('2A', '2B') OR (regexp_full_match(code, '[0-9]+')
           AND coalesce(try_cast(code AS bigint) BETWEEN 1 AND 95, false)) AS metropolitan FROM c
    """,
)
def is_metropolitan(t):
    code = F.expr(
        f"CASE WHEN c_custkey % 999 >= 100 AND c_custkey % 7 > 2 THEN cast(c_custkey % 999 AS string) ELSE {_CODE} END"
    )
    return t.table("customer").select(
        "c_custkey", code.alias("code"), values.is_metropolitan(code).alias("metropolitan")
    )


def _sql_case(column: str, pairs: dict[str, str]) -> str:
    branches = " ".join(f"WHEN '{key}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for key, text in pairs.items())
    return f"CASE {column} {branches} END"


_DEPT_CODE = "lpad(cast(c_custkey % 99 AS varchar(20)), 2, '0')"


@query(
    "department_name",
    f"""SELECT c_custkey, coalesce({_sql_case(_DEPT_CODE, DEPARTMENT_NAMES)},
               concat('Département ', {_DEPT_CODE})) AS department_name FROM customer""",
)
def department_name(t):
    return t.table("customer").select("c_custkey", values.department_name(F.expr(_DEPT_CODE)).alias("department_name"))


_MNEMONIC = (
    "CASE p_size % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'QRR1' WHEN 2 THEN concat('Q', upper(replace(p_name, ' ', '_'))) "
    "ELSE concat('STATUS_', upper(replace(p_name, ' ', '_')), cast(p_size AS varchar(20)), 'S') END"
)
_TITLE = (
    "array_to_string(list_transform(regexp_extract_all(replace({0}, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), "
    "lambda x: upper(x[1]) || lower(x[2:])), '')"
)


@query(
    "metric_label",
    f"""
    WITH m AS (SELECT p_partkey, {_MNEMONIC} AS name FROM part),
    q AS (SELECT *, CASE WHEN name LIKE 'Q%' THEN substr(name, 2) END AS quality_for FROM m)
    SELECT p_partkey, name AS source_mnemonic, quality_for,
           CASE WHEN quality_for IS NOT NULL
                THEN concat('Quality code for ', coalesce({_sql_case('quality_for', METRIC_LABELS)}, quality_for))
                ELSE coalesce({_sql_case('name', METRIC_LABELS)}, {_TITLE.format('name')}) END AS english_label,
           NOT (name = 'T') AS categorical
    FROM q
    """,
)
def metric_label(t):
    name = F.expr(_MNEMONIC)
    kind = F.when(name == "T", "float").otherwise("uint8")
    columns = t.table("part").select("p_partkey", name.alias("source_mnemonic"), kind.alias("physical_type"))
    return metrics.describe_columns(columns).select(
        "p_partkey", "source_mnemonic", "quality_for", "english_label", "categorical"
    )


@query(
    "quality_for_column",
    """
    WITH c AS (SELECT DISTINCT unnest(columns) AS "column" FROM headers)
    SELECT "column", CASE WHEN "column" LIKE 'Q%' AND substr("column", 2) IN (SELECT "column" FROM c)
           THEN substr("column", 2) END AS quality_for FROM c
    """,
    ("headers",),
)
def quality_for_column(t):
    columns = t.view("headers").select(F.explode("columns").alias("column")).distinct()
    return profiling.quality_targets(columns)


_KNOWN = ", ".join(f"'{name}'" for name in sorted(KNOWN_CODE_COLUMNS))


@query(
    "unknown_quality_columns",
    f"""SELECT source_file, array_to_string(list_sort(list_distinct(list_filter(columns,
               lambda c: c LIKE 'Q%' AND c NOT IN ({_KNOWN})))), ',') AS unknown FROM headers""",
    ("headers",),
)
def unknown_quality_columns(t):
    headers = t.view("headers").withColumnRenamed("source_file", "filename")
    return ingest.unknown_code_columns(headers).select(
        F.col("filename").alias("source_file"), F.array_join("unknown_quality_columns", ",").alias("unknown")
    )


@query(
    "haversine_km",
    """
    WITH p AS (SELECT c_custkey, 42e0 + (c_custkey * 29 % 900) / 1e2 AS a, -4.8e0 + (c_custkey * 31 % 1280) / 1e2 AS b,
                      45e0 + c_nationkey / 1e1 AS c, c_nationkey / 5e0 AS d FROM customer),
    h AS (SELECT *, pow(sin(radians(c - a) / 2), 2)
                    + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2) AS v FROM p)
    SELECT c_custkey, round(6371.0088e0 * 2 * atan2(sqrt(v), sqrt(1 - v)), 6) AS distance_km FROM h
    """,
)
def haversine(t):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    distance = haversine_km(
        F.lit(42.0) + key * 29 % 900 / 100.0, F.lit(-4.8) + key * 31 % 1280 / 100.0,
        F.lit(45.0) + nation / 10.0, nation / 5.0,
    )
    return rounded(t.table("customer").select("c_custkey", distance.alias("distance_km")), "distance_km", digits=6)


@query(
    "numeric_parse_flag",
    "SELECT source_file, source_row_number, try_cast(nullif(RR1, '') AS double) IS NOT NULL AS is_number FROM raw",
    ("raw",),
)
def numeric_parse_flag(t):
    return t.raw.select(
        "source_file", "source_row_number", values.is_finite_number(F.col("RR1")).alias("is_number")
    )


@query(
    "json_encode_sets",
    """SELECT NUM_POSTE, cast(to_json(list_sort(list(DISTINCT NOM_USUEL))) AS varchar) AS names
       FROM raw WHERE NOT is_malformed GROUP BY 1""",
    ("raw",),
)
def json_encode_sets(t):
    pairs = profiling.well_formed(t.raw).select("NUM_POSTE", "NOM_USUEL").distinct()
    return pairs.groupBy("NUM_POSTE").agg(values.json_set(F.collect_list("NOM_USUEL")).alias("names"))


@query(
    "age_span_seconds",
    """SELECT NUM_POSTE, epoch(max(date_trunc('second', observation_time_utc)))::bigint
              - epoch(min(date_trunc('second', observation_time_utc)))::bigint AS span_seconds
       FROM obs GROUP BY 1""",
    ("obs",),
)
def age_span_seconds(t):
    span = timeops.span_seconds(F.min("observation_time_utc"), F.max("observation_time_utc"))
    return t.obs.groupBy("NUM_POSTE").agg(span.alias("span_seconds"))


@query(
    "schema_fingerprint",
    """SELECT source_file, substr(sha256(array_to_string(columns, chr(31))), 1, 12) AS schema_id FROM headers""",
    ("headers",),
)
def schema_fingerprint(t):
    return t.view("headers").select("source_file", values.schema_fingerprint(F.col("columns")).alias("schema_id"))


@query(
    "year_ranges",
    """SELECT DISTINCT department, year FROM
       (SELECT department, unnest(range(period_start, period_end + 1)) AS year FROM files_now)""",
    ("files_now",),
)
def year_ranges(t):
    return audits.years_of_files(t.view("files_now")).withColumn("year", F.col("year").cast("bigint"))



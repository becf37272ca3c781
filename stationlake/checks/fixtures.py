"""Weather-shaped views of the test tables, in one SQL text for Spark and DuckDB.

Expressions such as ``event_id % 97`` vary values between rows; no view drops rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from stationlake.session import configure

PARIS = {
    "spark": "from_utc_timestamp(cast({0} AS timestamp), 'Europe/Paris')",
    "duckdb": "(({0} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris')",
}

DEPARTMENT = (
    "CASE {0} % 5 WHEN 0 THEN '01' WHEN 1 THEN '2A' WHEN 2 THEN '35' WHEN 3 THEN '44' ELSE '75' END"
)
USER_DEPARTMENT = DEPARTMENT.format("user_id")
USER_CODE = "lpad(cast(user_id AS varchar(20)), 8, '0')"
# Places inside a box around France; codes far apart share no place.
USER_LAT = "42e0 + ((user_id * 37) % 900) / 1e2"
USER_LON = "-4.8e0 + ((user_id * 53) % 1280) / 1e2"
EVENT_CODE = (
    "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 "
    "WHEN 'signup' THEN 9 ELSE NULL END"
)

# Station-hours of one month: the shape of hourly_core.
OBS = f"""
SELECT {USER_DEPARTMENT} AS department, 'main' AS network_category, {USER_CODE} AS NUM_POSTE,
       concat('STATION ', cast(user_id AS varchar(20)),
              CASE WHEN event_id % 97 = 0 THEN ' BIS' ELSE '' END) AS NOM_USUEL,
       {USER_LAT} AS LAT, {USER_LON} AS LON, cast(10 + user_id % 7 AS int) AS ALTI,
       event_id, cast(ts AS timestamp) AS observation_time_utc,
       cast({{local}} AS date) AS local_date,
       cast(extract(hour FROM {{local}}) AS smallint) AS local_hour,
       cast(extract(year FROM ts) AS int) AS year,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS T, {EVENT_CODE} AS QT,
       value / 1e1 AS RR1, {EVENT_CODE} AS QRR1
FROM {{events}}
"""

# Several years of a few stations that report more than once a day.
HIST_TIME = "o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR"
HIST = f"""
SELECT {DEPARTMENT.format('o_custkey')} AS department, 'main' AS network_category,
       lpad(cast(o_custkey % 5 AS varchar(20)), 8, '0') AS NUM_POSTE,
       concat('STATION ', cast(o_custkey % 5 AS varchar(20))) AS NOM_USUEL,
       45e0 + o_custkey % 5 AS LAT, 1e0 + o_custkey % 5 AS LON, cast(100 AS int) AS ALTI,
       o_orderkey, cast({HIST_TIME} AS timestamp) AS observation_time_utc,
       cast({{local}} AS date) AS local_date,
       cast(extract(hour FROM {{local}}) AS smallint) AS local_hour,
       cast(extract(year FROM {HIST_TIME}) AS int) AS year,
       o_totalprice / 1e3 AS T,
       CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 9 END AS QT,
       o_totalprice / 1e4 AS RR1,
       CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 9 END AS QRR1
FROM {{orders}}
"""

# Text rows as they lie in archives: overlapping files, bad times, short lines.
RAW_TIME = {
    "spark": "date_format(cast(ts AS timestamp), 'yyyyMMddHH')",
    "duckdb": "strftime(ts, '%Y%m%d%H')",
}
RAW = f"""
SELECT concat('H_', {USER_DEPARTMENT}, CASE event_id % 3 WHEN 0 THEN '_2010-2024'
              WHEN 1 THEN '_previous-2020-2024' ELSE '_latest-2024-2026' END, '.csv.gz') AS source_file,
       cast(CASE event_id % 3 WHEN 0 THEN 2010 WHEN 1 THEN 2020 ELSE 2024 END AS int) AS period_start,
       cast(CASE event_id % 3 WHEN 2 THEN 2026 ELSE 2024 END AS int) AS period_end,
       event_id + 2 AS source_row_number,
       (event_id % 401 = 0 OR event_id % 997 = 0) AS is_malformed,
       {USER_CODE} AS NUM_POSTE,
       concat('STATION ', cast(user_id AS varchar(20)),
              CASE WHEN event_id % 97 = 0 THEN ' BIS' ELSE '' END) AS NOM_USUEL,
       cast({USER_LAT} AS varchar(20)) AS LAT, cast({USER_LON} AS varchar(20)) AS LON,
       cast(10 + user_id % 7 + CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END AS varchar(20)) AS ALTI,
       CASE WHEN event_id % 211 = 0 THEN 'invalid' ELSE {{raw_time}} END AS AAAAMMJJHH,
       CASE WHEN event_type = 'purchase' THEN '' ELSE cast(value AS varchar(20)) END AS T,
       CASE event_type WHEN 'view' THEN '0' WHEN 'click' THEN '1' WHEN 'error' THEN '2'
            WHEN 'signup' THEN '9' ELSE '' END AS QT,
       CASE WHEN event_id % 50 = 0 THEN 'tr' ELSE cast(value AS varchar(20)) END AS RR1,
       CASE WHEN event_id % 4 = 0 THEN '' ELSE '1' END AS QRR1
FROM {{events}}
"""
RAW_COLUMNS = ("NUM_POSTE", "NOM_USUEL", "LAT", "LON", "ALTI", "AAAAMMJJHH", "T", "QT", "RR1", "QRR1")

# One row per station-hour, as archives hold them that pass a publication.
STATION_HOURS = """
SELECT concat('H_44', CASE user_id % 3 WHEN 0 THEN '_2010-2024' WHEN 1 THEN '_previous-2020-2024'
              ELSE '_latest-2024-2026' END, '.csv.gz') AS source_file,
       concat('44', lpad(cast(user_id AS varchar(20)), 6, '0')) AS NUM_POSTE,
       concat('STATION ', cast(user_id AS varchar(20))) AS NOM_USUEL,
       cast({lat} AS varchar(20)) AS LAT, cast({lon} AS varchar(20)) AS LON,
       cast(10 + user_id % 7 AS varchar(20)) AS ALTI, {{raw_time}} AS AAAAMMJJHH,
       cast(max(value) AS varchar(20)) AS T, cast(count(*) AS varchar(20)) AS QT,
       CASE WHEN min(event_id) % 3 = 0 THEN '' ELSE cast(min(value) AS varchar(20)) END AS RR1, '1' AS QRR1,
       CASE WHEN min(event_id) % 5 = 0 THEN '8.5' ELSE '' END AS T10,
       CASE WHEN min(event_id) % 7 = 0 THEN '11.25' ELSE '' END AS TMER,
       CASE WHEN min(event_id) % 11 = 0 THEN '2' ELSE '' END AS NEIGETOT
FROM {{events}} GROUP BY user_id, {{raw_time}}
""".format(lat=USER_LAT, lon=USER_LON)
STATION_HOUR_COLUMNS = (
    "NUM_POSTE", "NOM_USUEL", "LAT", "LON", "ALTI", "AAAAMMJJHH", "T", "QT", "RR1", "QRR1", "T10", "TMER",
    "NEIGETOT",
)

# Headers of archives: one per part, with columns that differ by type and size.
HEADERS = """
SELECT concat('A', cast(p_partkey AS varchar(20)), '.csv.gz') AS source_file,
       cast(1950 + p_size AS int) AS period_start, cast(1959 + p_size AS int) AS period_end,
       cast(floor(p_retailprice * 1e2 + 5e-1) AS bigint) AS compressed_size,
       {list}('NUM_POSTE', 'AAAAMMJJHH', upper(p_type), concat('Q', upper(p_type)),
             concat('QX', cast(p_size % 10 AS varchar(20)))) AS columns
FROM {part}
"""

# Source files now and in the last manifest: new, changed, removed and unchanged.
FILES_NOW = f"""
SELECT {DEPARTMENT.format('s_suppkey')} AS department,
       concat('F', cast(s_suppkey AS varchar(20)), '.csv.gz') AS filename,
       cast(1950 + s_suppkey % 60 AS bigint) AS period_start,
       cast(1959 + s_suppkey % 60 AS bigint) AS period_end,
       cast(floor(abs(s_acctbal) * 1e2 + 5e-1) AS bigint) AS size, s_suppkey * 1000000 AS mtime_ns,
       concat('sha', cast(s_suppkey AS varchar(20))) AS sha256
FROM {{supplier}}
"""
FILES_BEFORE = f"""
SELECT {DEPARTMENT.format('s_suppkey')} AS department,
       concat(CASE WHEN s_suppkey % 11 = 0 THEN 'GONE' ELSE 'F' END,
              cast(s_suppkey AS varchar(20)), '.csv.gz') AS filename,
       cast(1950 + s_suppkey % 60 AS bigint) AS period_start,
       cast(1959 + s_suppkey % 60 AS bigint) AS period_end,
       cast(floor(abs(s_acctbal) * 1e2 + 5e-1) AS bigint) AS size, s_suppkey * 1000000 AS mtime_ns,
       concat(CASE WHEN s_suppkey % 13 = 0 THEN 'old' ELSE 'sha' END,
              cast(s_suppkey AS varchar(20))) AS sha256
FROM {{supplier}}
"""

# Catalog records, local files, partial files and server answers.
RESOURCES = """
SELECT concat('id', cast(p_partkey AS varchar(20))) AS id,
       CASE p_partkey % 4
            WHEN 0 THEN concat('HOR_departement_', lpad(cast(1 + p_size AS varchar(20)), 2, '0'), '_periode_',
                               cast(1950 + p_size AS varchar(20)), '-', cast(1959 + p_size AS varchar(20)))
            WHEN 1 THEN concat('Horaires 2A décennie ', cast(1900 + p_size AS varchar(20)), '_',
                               cast(1909 + p_size AS varchar(20)))
            WHEN 2 THEN NULL ELSE 'Notice' END AS title,
       concat('https://files.test/base/HOR/H_', lpad(cast(1 + p_size AS varchar(20)), 2, '0'), '_',
              CASE p_partkey % 3 WHEN 0 THEN 'latest-' ELSE '' END,
              cast(1950 + p_size AS varchar(20)), '-', cast(1959 + p_size AS varchar(20)), '-',
              cast(p_partkey AS varchar(20)), '%20v1.csv.gz') AS url,
       CASE p_partkey % 5 WHEN 0 THEN 'csv' ELSE 'csv.gz' END AS format,
       CASE p_partkey % 9 WHEN 0 THEN 'documentation' ELSE 'main' END AS type,
       cast(NULL AS varchar(20)) AS last_modified,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE cast(floor(p_retailprice * 1e2 + 5e-1) AS bigint) END AS filesize
FROM {part}
"""
CATALOG_FILES = """
SELECT concat('R', cast(p_partkey AS varchar(20))) AS filename, p_partkey,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE cast(floor(p_retailprice * 1e2 + 5e-1) AS bigint) END AS expected_size
FROM {part}
"""
LOCAL_FILES = """
SELECT concat(CASE WHEN p_partkey % 6 = 0 THEN 'X' ELSE 'R' END, cast(p_partkey AS varchar(20))) AS filename,
       cast(floor(p_retailprice * 1e2 + 5e-1) AS bigint) + CASE WHEN p_partkey % 7 < 2 THEN 5 ELSE 0 END AS size
FROM {part}
"""
PARTIAL_FILES = """
SELECT concat(CASE WHEN p_partkey % 4 = 0 THEN 'R' ELSE 'X' END, cast(p_partkey AS varchar(20))) AS filename,
       cast(floor(p_retailprice * 1e2 + 5e-1) AS bigint) AS size
FROM {part}
"""
SERVER_SIZES = """
SELECT concat('R', cast(p_partkey AS varchar(20))) AS filename,
       CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN cast(floor(p_retailprice * 1e2 + 5e-1) AS bigint) + 5
            ELSE cast(floor(p_retailprice * 1e2 + 5e-1) AS bigint) + 9 END AS server_size,
       CASE WHEN p_partkey % 6 = 3 THEN 'timeout' ELSE NULL END AS remote_error
FROM {part}
"""

# Points to estimate values for, and polygons with a hole around suppliers.
POINTS = """
SELECT c_custkey AS point_id, 42e0 + ((c_custkey * 29) % 900) / 1e2 AS LAT,
       -4.8e0 + ((c_custkey * 31) % 1280) / 1e2 AS LON
FROM {customer}
"""
CENTRE_LAT = "43e0 + ((s_suppkey * 41) % 700) / 1e2"
CENTRE_LON = "-4e0 + ((s_suppkey * 67) % 1100) / 1e2"
HALF = "(2e-1 + (s_suppkey % 7) / 2e1)"


def _square(scale: str) -> str:
    y, x = CENTRE_LAT, CENTRE_LON
    steps = [("-", "-"), ("+", "-"), ("+", "+"), ("-", "+"), ("-", "-")]
    # A sheared square, so that edges are not parallel to the grid.
    points = [f"{{pair}}({x} {a} {HALF} * {scale}, {y} {b} {HALF} * {scale} {a} 3e-2)" for a, b in steps]
    return "{list}(" + ", ".join(points) + ")"


BOUNDARIES = f"""
SELECT cast(s_suppkey AS varchar(20)) AS code, s_name AS nom, cast(s_nationkey AS varchar(20)) AS region,
       {{list}}({{list}}({_square('1e0')}, {_square('4e-1')})) AS polygons
FROM {{supplier}}
"""

TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier", "documents")
DIALECT = {
    "spark": {"list": "array", "pair": "array"},
    "duckdb": {"list": "list_value", "pair": "list_value"},
}


def _text(template: str, dialect: str, time: str | None = None) -> str:
    names = {table: "{" + table + "}" if dialect == "spark" else table for table in TABLES}
    local = PARIS[dialect].format(time) if time else ""
    return template.format(local=local, raw_time=RAW_TIME[dialect], **DIALECT[dialect], **names)


VIEWS = {
    "obs": (OBS, "ts"),
    "hist": (HIST, f"({HIST_TIME})"),
    "raw": (RAW, None),
    "station_hours": (STATION_HOURS, None),
    "headers": (HEADERS, None),
    "files_now": (FILES_NOW, None),
    "files_before": (FILES_BEFORE, None),
    "resources": (RESOURCES, None),
    "catalog_files": (CATALOG_FILES, None),
    "local_files": (LOCAL_FILES, None),
    "partial_files": (PARTIAL_FILES, None),
    "server_sizes": (SERVER_SIZES, None),
    "points": (POINTS, None),
    "boundaries": (BOUNDARIES, None),
}


def duckdb_views(*names: str) -> str:
    """A WITH clause that defines fixture views for an oracle query."""
    return "WITH " + ", ".join(f"{n} AS ({_text(VIEWS[n][0], 'duckdb', VIEWS[n][1])})" for n in names)


class Tables:
    """The test tables of one folder and the fixture views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        template, time = VIEWS[name]
        text = _text(template, "spark", time)
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def obs(self) -> DataFrame:
        return self.view("obs")

    @cached_property
    def hist(self) -> DataFrame:
        return self.view("hist")

    @cached_property
    def raw(self) -> DataFrame:
        return self.view("raw")

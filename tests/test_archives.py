"""Discovery, probing, staging and reports on generated archives."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stationlake.functions import values
from stationlake.operators import profiling
from stationlake.plans import inspection
from stationlake.sources import archives as raw
from stationlake.sources.dictionary import read_dictionary
from tests.conftest import write_gzip

HEADER = "NUM_POSTE;NOM_USUEL;LAT;LON;ALTI;AAAAMMJJHH;T;QT;RR1;QRR1"


def probe(spark, root, **filters):
    return raw.probe_headers(raw.discover_archives(spark, str(root), **filters))


def test_discovery_by_name_department_and_period(spark, folder):
    for name in (
        "H_44_2010-2019.csv.gz", "H_44_previous-2020-2024.csv.gz", "H_2A_latest-2025-2026.csv.gz",
        "H_44_2010-2019.csv.gz.part", "notes.csv.gz", "H_4_2010-2019.csv.gz",
    ):
        write_gzip(folder / name, [HEADER])
    every = [r.filename for r in raw.discover_archives(spark, str(folder)).collect()]
    assert every == ["H_2A_latest-2025-2026.csv.gz", "H_44_2010-2019.csv.gz", "H_44_previous-2020-2024.csv.gz"]
    chosen = raw.discover_archives(spark, str(folder), {"44"}, 2015, 2019).collect()
    assert [(r.filename, r.period_start, r.period_end) for r in chosen] == [("H_44_2010-2019.csv.gz", 2010, 2019)]


def test_headers_encodings_and_errors(spark, folder):
    write_gzip(folder / "H_01_2010-2019.csv.gz", ["NOM;VALEUR", "Café;1"], "cp1252")
    write_gzip(folder / "H_02_2010-2019.csv.gz", ["﻿NOM,VALEUR", "Café,1"])
    write_gzip(folder / "H_03_2010-2019.csv.gz", [])
    write_gzip(folder / "H_04_2010-2019.csv.gz", ["A;;B", "1;2;3"])
    (folder / "H_05_2010-2019.csv.gz").write_bytes(b"not gzip")
    rows = {r.department: r for r in probe(spark, folder).collect()}
    assert (rows["01"].encoding, rows["01"].delimiter, rows["01"].columns) == ("cp1252", ";", ["NOM", "VALEUR"])
    assert (rows["02"].encoding, rows["02"].delimiter, rows["02"].columns) == ("utf-8-sig", ",", ["NOM", "VALEUR"])
    assert "no header" in rows["03"].inspection_error
    assert "unnamed column" in rows["04"].inspection_error
    assert rows["05"].inspection_error


def test_staging_numbers_lines_in_every_file(spark, folder):
    # Many small files: each must count its own lines although Spark would pack them.
    for n in range(12):
        lines = [HEADER] + [f"S{n};NAME;1;2;3;20240101{h:02d};{h}.5;1;;" for h in range(n + 1)]
        write_gzip(folder / "raw" / f"H_{n + 1:02d}_2020-2024.csv.gz", lines)
    headers = probe(spark, folder / "raw")
    rows = raw.stage_archives(spark, headers, str(folder / "stage"))
    spans = rows.groupBy("department").agg(
        F.min("source_row_number").alias("a"), F.max("source_row_number").alias("b"), F.count("*").alias("n")
    )
    assert {r.department: (r.a, r.b, r.n) for r in spans.collect()} == {
        f"{n + 1:02d}": (2, n + 2, n + 1) for n in range(12)
    }


def test_staging_quotes_blank_lines_and_other_layouts(spark, folder):
    write_gzip(folder / "raw" / "H_01_2020-2024.csv.gz", ["NUM_POSTE;T", '"A;1";1', "", "B;2;3", "C", "D;"])
    write_gzip(folder / "raw" / "H_02_2020-2024.csv.gz", ["T,NUM_POSTE,NOM", "4,É,Café"], "cp1252")
    rows = raw.stage_archives(spark, probe(spark, folder / "raw"), str(folder / "stage")).orderBy(
        "source_file", "source_row_number"
    ).collect()
    assert [(r.source_row_number, r.is_malformed) for r in rows] == [
        (2, False), (3, True), (4, True), (5, True), (6, False), (2, False),
    ]
    assert (rows[0].NUM_POSTE, rows[0].T, rows[0].NOM) == ("A;1", "1", None)
    assert (rows[4].NUM_POSTE, rows[4].T) == ("D", None)
    assert (rows[5].NUM_POSTE, rows[5].T, rows[5].NOM) == ("É", "4", "Café")


def csv_records(content: bytes, delimiter: str):
    """Records by the standard library, with the line breaks of the file."""
    return [row for row in csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8", newline=""), delimiter=delimiter)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 10_000])
def test_records_are_split_like_csv(chunk):
    dice = random.Random(chunk)
    cells = ["a", "", "x y", '"q"', '"a;b"', '"two\nlines"', '"three\r\nlong\n"', '""', '"say ""hi"""', 'mid"dle', '"é"', '"""";']
    for _ in range(60):
        content = b"H1;H2\n" + b"".join(
            ";".join(dice.choice(cells) for _ in range(dice.randrange(1, 4))).encode() + dice.choice([b"\n", b"\r\n", b"\r", b"\n"])
            for _ in range(dice.randrange(12))
        )
        splitter, found = raw.RecordSplitter(), []
        for at in range(0, len(content), chunk):
            found += splitter.feed(content[at : at + chunk])
        found += splitter.feed(b"", last=True)
        right = csv_records(content, ";")
        assert [n for n, _, _, _ in found] == list(range(1, len(right) + 1))
        assert [next(csv.reader(io.StringIO(r.decode(), newline=""), delimiter=";"), []) for _, _, r, _ in found] == right
        assert not any(broken for _, _, _, broken in found)


def test_a_quote_that_is_never_closed_breaks_its_own_line_only(monkeypatch):
    monkeypatch.setattr(raw, "MOST_RECORD_BYTES", 40)
    lines = [b"A;B", b'1;"open', b"2;x", b'3;fine', b"4;" + b"y" * 50, b'5;"also open', b"6;z"]
    splitter = raw.RecordSplitter()
    found = splitter.feed(b"\n".join(lines)) + splitter.feed(b"", last=True)
    assert [(n, line, r, b) for n, line, r, b in found] == [
        (n, n, line, line in (lines[1], lines[5])) for n, line in enumerate(lines, 1)
    ]


def test_quoted_line_breaks_are_staged_and_numbered(spark, folder):
    write_gzip(folder / "raw" / "H_01_2020-2024.csv.gz", [
        "NUM_POSTE;NOM;T", '1;"PHARE\nDU NORD";2.5', '2;"A ""B"" C";3', "3;PLAIN;4", '4;"never closed;5', "5;LAST;6",
    ])
    headers, records = raw.read_archives(spark, raw.discover_archives(spark, str(folder / "raw")), str(folder / "work"))
    rows = raw.parse_records(spark, records, headers, str(folder / "rows")).orderBy("source_row_number").collect()
    assert [(r.source_row_number, r.NUM_POSTE, r.NOM, r.T) for r in rows if not r.is_malformed] == [
        (2, "1", "PHARE\nDU NORD", "2.5"), (3, "2", 'A "B" C', "3"), (4, "3", "PLAIN", "4"), (6, "5", "LAST", "6"),
    ]
    assert [r.source_row_number for r in rows if r.is_malformed] == [5]
    lines = {r.record_number: r.line_number for r in records.collect()}
    assert lines == {1: 1, 2: 2, 3: 4, 4: 5, 5: 6, 6: 7}


def test_every_archive_is_opened_once(spark, folder):
    """Staged records alone give headers, encodings, rows and errors."""
    write_gzip(folder / "raw" / "H_01_2020-2024.csv.gz", ["NOM;VALEUR", "Café;1"], "cp1252")
    write_gzip(folder / "raw" / "H_02_2020-2024.csv.gz", ["\ufeffNOM,VALEUR", "Café,2"])
    write_gzip(folder / "raw" / "H_03_2020-2024.csv.gz", [])
    (folder / "raw" / "H_04_2020-2024.csv.gz").write_bytes(b"not gzip")
    listed = raw.discover_archives(spark, str(folder / "raw"))
    headers, records = raw.read_archives(spark, listed, str(folder / "work"))
    found = {r.department: r for r in headers.collect()}
    probed = {r.department: r for r in raw.probe_headers(listed).collect()}
    for code in ("01", "02", "03"):
        assert found[code] == probed[code]
    assert found["04"].inspection_error and probed["04"].inspection_error
    for path in (folder / "raw").iterdir():
        path.write_bytes(b"gone")
    rows = raw.parse_records(spark, records, headers, str(folder / "rows")).collect()
    assert sorted((r.NOM, r.VALEUR) for r in rows) == [("Café", "1"), ("Café", "2")]


def test_fingerprints_reuse_known_digests(spark, folder):
    path = write_gzip(folder / "H_44_2020-2024.csv.gz", [HEADER])
    listed = raw.discover_archives(spark, str(folder))
    first = raw.fingerprint_archives(listed).collect()[0]
    assert first.sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    known = spark.createDataFrame(
        [(first.filename, first.size, first.mtime_ns, "kept")], "filename string, size bigint, mtime_ns bigint, sha256 string"
    )
    assert raw.fingerprint_archives(listed, known).first().sha256 == "kept"
    stale = known.withColumn("size", F.col("size") + 1)
    assert raw.fingerprint_archives(listed, stale).first().sha256 == first.sha256


def test_dictionary_keeps_last_and_skips_prose(spark, folder):
    path = folder / "fields.csv"
    path.write_text("﻿T : température (en °C)\nune phrase : non\nT : reprise : deux (en K)\n\nvide\n", "utf-8")
    rows = {r.name: r.description for r in read_dictionary(spark, str(path)).collect()}
    assert rows == {"T": "reprise : deux (en K)"}
    assert read_dictionary(spark, str(folder / "none.csv")).count() == 0


@pytest.fixture
def department(folder):
    write_gzip(folder / "raw" / "H_44_2010-2019.csv.gz", [
        HEADER,
        "44000001;PHARE;47.1;-2.0;5;2019123123;3.5;1;;",
        "44000001;PHARE;47.1;-2.0;5;bad;4.0;9;0.0;1",
        "44000002;BOURG;47.3;-1.5;30;2018060112;;9;1.2;1",
        "too;short",
    ])
    write_gzip(folder / "raw" / "H_44_previous-2020-2024.csv.gz", [
        HEADER,
        "44000001;PHARE NEUF;47.1;-2.0;6;2019123123;3.5;1;0.0;1",
        "44000001;PHARE NEUF;47.1;-2.0;6;2020010100;5.0;9;0.0;1",
    ])
    return folder


def test_exploration_of_a_department(spark, department):
    before = {p.name: p.read_bytes() for p in (department / "raw").iterdir()}
    reports = str(department / "reports")
    summary = inspection.explore_department(spark, str(department / "raw"), reports, "44")
    assert summary == {
        "archives": 2, "stations": 2, "errors": 0, "duplicates": 1, "cross_archive_overlaps": 1,
        "station_years_with_90_percent_temperature": 0, "metadata_conflicts": 2,
    }
    assert {p.name: p.read_bytes() for p in (department / "raw").iterdir()} == before
    inventory = spark.read.parquet(f"{reports}/archive_inventory").orderBy("filename").collect()
    assert [(r.row_count, r.malformed_rows, r.invalid_timestamps, r.station_count) for r in inventory] == [
        (4, 1, 1, 2), (2, 0, 0, 1),
    ]
    provenance = spark.read.parquet(f"{reports}/archive_inventory").schema[0].metadata["provenance"]
    assert json.loads(provenance)["archive_count"] == 2
    profile = spark.read.parquet(f"{reports}/column_profile").where("column = 'T'").orderBy("source_file").first()
    assert (profile.populated_count, profile.null_count, profile.numeric_max) == (2, 1, 4.0)
    assert (json.loads(profile.examples), profile.is_core_dashboard_field) == (["3.5", "4.0"], True)
    codes = spark.read.parquet(f"{reports}/quality_code_profile").where("column = 'QT'").collect()
    assert {r.value for r in codes} == {"1", "9"}
    conflicts = spark.read.parquet(f"{reports}/station_metadata_conflicts").collect()
    assert {(r.field, r.value_count) for r in conflicts} == {("name", 2), ("altitude", 2)}
    overlap = spark.read.parquet(f"{reports}/archive_overlaps").first()
    assert overlap.source_files == ["H_44_2010-2019.csv.gz", "H_44_previous-2020-2024.csv.gz"]


def test_exploration_by_years_and_without_archives(spark, department):
    root = str(department / "raw")
    summary = inspection.explore_department(spark, root, str(department / "r2"), "44", 2020, 2020)
    assert (summary["archives"], summary["stations"]) == (1, 1)
    nothing = inspection.explore_department(spark, root, str(department / "r3"), "35")
    assert nothing == {"archives": 0, "stations": 0, "errors": 1}


def test_inspection_modes(spark, department):
    root, reports = str(department / "raw"), str(department / "reports")
    write_gzip(department / "raw" / "H_35_2020-2024.csv.gz", [])
    (department / "fields.csv").write_text("T : température (en °C)\n", "utf-8")
    result = inspection.inspect_archives(
        spark, root, reports, "profile", dictionary_path=str(department / "fields.csv")
    )
    assert result == {"selected": 3, "schemas": 1, "errors": 1}
    coverage = spark.read.parquet(f"{reports}/column_coverage").where("column = 'T'").first()
    assert (coverage.archive_count, coverage.archive_percentage) == (2, 100.0)
    listed = spark.read.parquet(f"{reports}/column_dictionary").where("column = 'T'").first()
    assert listed.documented and listed.archive_percentage == pytest.approx(200 / 3)
    assert spark.read.parquet(f"{reports}/column_dictionary").where("column = 'QT'").first().quality_for == "T"
    profile = spark.read.parquet(f"{reports}/profile_summary").where("column = 'T'").first()
    smallest = min((department / "raw").glob("H_44*"), key=lambda p: p.stat().st_size).name
    assert profile.filename == smallest
    schema_only = inspection.inspect_archives(spark, root, str(department / "r2"), "schema", {"44"})
    assert schema_only["errors"] == 0
    assert spark.read.parquet(str(department / "r2" / "archive_inventory")).first().row_count is None


def test_inventory_of_archives_without_time_column(spark, folder):
    write_gzip(folder / "raw" / "H_44_2010-2019.csv.gz", ["NUM_POSTE;T", "1;2.0", "2;3.0"])
    write_gzip(folder / "raw" / "H_45_2010-2019.csv.gz", ["NUM_POSTE;AAAAMMJJHH;T", "1;2010010100;2.0", "1;oops;2.0"])
    inspection.inspect_archives(spark, str(folder / "raw"), str(folder / "reports"), "inventory")
    rows = spark.read.parquet(str(folder / "reports" / "archive_inventory")).orderBy("filename").collect()
    assert [(r.station_count, r.invalid_timestamps) for r in rows] == [(2, 0), (1, 1)]
    assert rows[1].earliest_timestamp == "2010-01-01T00:00:00"


def test_reports_without_time_temperature_or_name_columns(spark, folder):
    """No archive has these columns: counts go on without them."""
    write_gzip(folder / "a" / "H_44_2010-2019.csv.gz", ["NUM_POSTE;RR1", "1;2.0", "2;3.0", "2;4.0"])
    inspection.inspect_archives(spark, str(folder / "a"), str(folder / "reports"), "profile")
    row = spark.read.parquet(str(folder / "reports" / "archive_inventory")).first()
    assert (row.row_count, row.station_count, row.invalid_timestamps, row.earliest_timestamp) == (3, 2, 0, None)
    profile = {r.column: r for r in spark.read.parquet(str(folder / "reports" / "profile_summary")).collect()}
    assert set(profile) == {"NUM_POSTE", "RR1"} and profile["RR1"].distinct_count == 3
    write_gzip(folder / "b" / "H_44_2010-2019.csv.gz", ["NUM_POSTE;AAAAMMJJHH;RR1", "1;2010010100;2.0", "1;2010010101;"])
    summary = inspection.explore_department(spark, str(folder / "b"), str(folder / "r2"), "44")
    assert (summary["stations"], summary["metadata_conflicts"], summary["errors"]) == (1, 0, 0)
    station = spark.read.parquet(str(folder / "r2" / "station_inventory")).first()
    assert (station.names, station.observation_count, station.temperature_count) == ("[]", 2, 0)
    years = spark.read.parquet(str(folder / "r2" / "station_year_temperature_coverage")).first()
    assert (years.observation_count, years.temperature_count) == (2, 0)
    summary = inspection.explore_department(spark, str(folder / "a"), str(folder / "r3"), "44")
    assert (summary["archives"], summary["stations"], summary["duplicates"]) == (1, 0, 0)


def test_repeated_keys_and_distinct_values(spark):
    rows = spark.createDataFrame(
        [("f", 2000, 2001, n, False, "1", "2000010100", str(n)) for n in range(5)],
        "source_file string, period_start int, period_end int, source_row_number bigint, is_malformed boolean, "
        "NUM_POSTE string, AAAAMMJJHH string, T string",
    )
    profile = {r.column: r for r in profiling.archive_profile(rows).collect()}
    assert profile["T"].duplicate_station_timestamp_count == 4
    assert profile["T"].distinct_count == 5 and profile["NUM_POSTE"].distinct_count == 1


WIDE = [f"C{n:02d}" for n in range(64)]


def _wide_rows(spark, count, files=3):
    """Rows of 64 columns in a mixed order, with blanks, repeats and values that come late."""
    rows = []
    for n in range(count):
        late = "late" if n > count - 5 else ""
        cells = [str((n * (k + 1)) % (k + 2)) if k % 3 else ("" if k % 2 else late) for k in range(64)]
        cells[5] = ["nan", "7", "x"][n % 3] if n % 11 == 0 else ""
        rows.append((f"f{n % files}", 2000, 2001, n // files + 2, n % 13 == 0, *cells))
    rows.sort(key=lambda r: (r[3] * 7919) % 1009)
    layout = "source_file string, period_start int, period_end int, source_row_number bigint, is_malformed boolean, "
    return rows, spark.createDataFrame(rows, layout + ", ".join(f"{name} string" for name in WIDE))


def test_column_summaries_equal_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(profiling, "HELD_FILES", 1)
    rows, frame = _wide_rows(spark, 700)
    found = {(r.source_file, r.column): r for r in profiling.column_profile(frame.repartition(5)).collect()}
    assert len(found) == 3 * 64
    for file in ("f0", "f1", "f2"):
        own = sorted((r for r in rows if r[0] == file and not r[4]), key=lambda r: r[3])
        for k, name in enumerate(WIDE):
            filled = [r[5 + k] for r in own if r[5 + k]]
            numbers = [float(v) for v in filled if v not in ("x", "late")]
            plain = [v for v in numbers if v == v]
            row = found[file, name]
            assert (row.populated_count, row.null_count) == (len(filled), len(own) - len(filled))
            assert json.loads(row.examples) == list(dict.fromkeys(filled))[:3]
            assert (row.numeric_min, row.numeric_max) == (min(plain, default=None), max(plain, default=None))
            assert row.inferred_type == ("numeric" if filled and len(numbers) == len(filled) else "string")


def test_column_profile_scans_once_and_shuffles_no_values(spark, folder):
    _wide_rows(spark, 300)[1].write.parquet(str(folder / "rows"))
    staged = spark.read.parquet(str(folder / "rows"))
    plan = profiling.column_profile(staged)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1
    exchange = next(line for line in plan.splitlines() if "Exchange" in line)
    assert "hashpartitioning(source_file" in exchange and "value" not in exchange


def test_profile_of_no_rows(spark):
    _, frame = _wide_rows(spark, 3)
    assert profiling.column_profile(frame.where("false")).count() == 0
    assert profiling.archive_profile(frame.where("false")).count() == 0


LAYOUT = (
    "source_file string, period_start int, period_end int, source_row_number bigint, is_malformed boolean, "
    "NUM_POSTE string, AAAAMMJJHH string, T string"
)


def test_repeated_hours_by_bitmaps_equal_a_plain_count(spark):
    dice = random.Random(5)
    rows = []
    for n in range(3000):
        station = dice.choice(["", "1", "2", None, "hot", "hot", "hot"])
        year, day, hour = dice.choice([2019, 2020]), dice.randrange(1, 29), dice.randrange(24)
        time = dice.choice([f"{year}12{day:02d}{hour:02d}"] * 8 + ["bad", "", None, f"{year}0101{hour:02d}"])
        rows.append((f"f{n % 3}", 2019, 2020, n, n % 50 == 0, station, time, "1"))
    frame = spark.createDataFrame(rows, LAYOUT)
    good = [r for r in rows if not r[4]]
    keys = Counter((r[0], r[5], r[6]) for r in good)
    repeats = Counter()
    for (file, _, _), count in keys.items():
        repeats[file] += count - 1
    found = {r.source_file: r.duplicate_station_timestamp_count for r in profiling.repeated_keys(frame).collect()}
    assert found == dict(repeats)
    times = Counter((r[5] or "", r[6]) for r in good if r[6] and r[6] != "bad")
    found = {(r.station_id, r.timestamp): r.record_count for r in profiling.duplicate_observations(frame).collect()}
    assert found == {key: count for key, count in times.items() if count > 1}


def test_clean_observations_are_not_shuffled(spark, folder):
    """A leap year of hours of many stations: only station-years travel."""
    hours = spark.range(8784).selectExpr("date_format(timestamp '2020-01-01' + make_interval(0, 0, 0, 0, cast(id AS int)), 'yyyyMMddHH') AS AAAAMMJJHH")
    clean = hours.selectExpr("'f' AS source_file", "2020 AS period_start", "2020 AS period_end", "1L AS source_row_number", "false AS is_malformed", "'7' AS NUM_POSTE", "AAAAMMJJHH", "'1' AS T")
    clean.write.parquet(str(folder / "clean"))
    result = profiling.duplicate_observations(spark.read.parquet(str(folder / "clean")))
    assert result.count() == 0
    plan = result._jdf.queryExecution().executedPlan().toString()
    # The semi join with the (few, stored) crowded years comes before any shuffle by timestamp.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin [crowded" not in plan
    again = profiling.duplicate_observations(spark.read.parquet(str(folder / "clean")).unionByName(clean.limit(3)))
    assert sorted(r.record_count for r in again.collect()) == [2, 2, 2]


def test_type_letters_and_hexadecimal_digits_are_no_numbers(spark):
    texts = ["12", "-1.5e3", ".5", "nan", "inf", "12d", "3F", "1.f", "0x1p3", "12d ", "abc", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(values.parse_number(F.col("v")).alias("n"))
    assert [r.n is not None for r in rows.collect()] == [True] * 5 + [False] * 7


def test_line_numbers_do_not_follow_session_settings(spark, folder):
    for number in range(6):
        write_gzip(folder / f"H_44_200{number}-200{number}.csv.gz", ["NUM_POSTE;T", f"{number};1", f"{number};2"])
    headers = raw.probe_headers(raw.discover_archives(spark, str(folder))).cache()
    spark.conf.set("spark.sql.files.maxPartitionNum", "2")
    try:
        rows = raw.stage_archives(spark, headers, str(folder / "staged")).collect()
        assert spark.conf.get("spark.sql.files.maxPartitionNum") == "2"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionNum")
    assert sorted({r.source_row_number for r in rows}) == [2, 3] and len(rows) == 12


def test_encoding_is_decided_over_the_whole_archive(spark, folder):
    lines = ["NUM_POSTE;NOM"] + [f"{n};PLAIN NAME" for n in range(9000)]
    write_gzip(folder / "raw" / "H_01_2020-2024.csv.gz", [*lines, "9;Café"], "cp1252")
    write_gzip(folder / "raw" / "H_02_2020-2024.csv.gz", [*lines, "9;Café"])
    with gzip.open(write_gzip(folder / "raw" / "H_03_2020-2024.csv.gz", lines, "cp1252"), "ab") as output:
        output.write(b"8;Caf\xe9\n9;bad \x81 byte\n")
    wide = [f"C{n:06d}" for n in range(12_000)]
    write_gzip(folder / "wide" / "H_04_2020-2024.csv.gz", [";".join(wide), "é;1"], "cp1252")
    headers = probe(spark, folder / "raw")
    assert {r.department: r.encoding for r in headers.collect()} == {"01": "cp1252", "02": "utf-8-sig", "03": "cp1252"}
    rows = raw.stage_archives(spark, headers, str(folder / "stage")).where("source_row_number > 9001")
    found = {(r.department, r.source_row_number): (r.NOM, r.is_malformed) for r in rows.collect()}
    assert found[("01", 9002)] == found[("02", 9002)] == found[("03", 9002)] == ("Café", False)
    assert found[("03", 9003)][1] and len(found) == 4
    row = probe(spark, folder / "wide").first()
    assert row.columns == wide and row.encoding == "cp1252"

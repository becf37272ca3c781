"""Publishing a department: facts, extensions, dimensions, manifests, repair."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stationlake.operators import audits, series
from stationlake.operators.selection import Selection
from stationlake.plans import repair, sync
from stationlake.schema import fact_schema, table_columns
from stationlake.session import settings
from stationlake.sinks import tables
from stationlake.sources.facts import read_table, register_views
from stationlake.sources.manifests import manifest_problems, read_manifests
from tests.conftest import write_gzip

HEADER = "NUM_POSTE;NOM_USUEL;LAT;LON;ALTI;AAAAMMJJHH;T;QT;RR1;QRR1;DD;T10;TMER;NEIGETOT;QODD"


def line(time, value="12.5", station="44000001", name="PORT", t10="", tmer="", neige=""):
    return f"{station};{name};47.2;-1.6;27;{time};{value};1;0.2;9;270.9;{t10};{tmer};{neige};1"


def archive(root, name, *lines):
    return write_gzip(root / "raw" / name, [HEADER, *lines])


def run(spark, root, department="44", **options):
    dictionary = root / "fields.csv"
    if not dictionary.exists():
        dictionary.write_text("T : température (en °C)\nRR1 : pluie (en mm)\n", "utf-8")
    return sync.sync_department(
        spark, str(root / "raw"), str(root / "out"), str(dictionary), department, **options
    )


def test_schema_types():
    core = fact_schema("hourly_core")
    assert core["T"].dataType.simpleString() == "float"
    assert core["QT"].dataType.simpleString() == "smallint"
    assert core["DD"].dataType.simpleString() == "int"
    assert len(table_columns("hourly_core")) == 69 * 2 + 2


def test_first_sync_writes_facts_extensions_and_dimensions(spark, folder):
    archive(
        folder, "H_44_previous-2020-2024.csv.gz",
        line("2024033100", t10="8.2"), line("2024033101", tmer="11"), line("2024102700", neige="2"),
        line("2024102701", name="PORT NEUF"),
    )
    result = run(spark, folder)
    assert result.status == "synchronized", result.error
    assert result.counts["core_rows"] == 4
    assert result.counts["extension_rows"] == {"hourly_surface": 1, "hourly_marine": 1, "hourly_snow": 1}
    root = str(folder / "out")
    rows = read_table(spark, root, "hourly_core").orderBy("observation_time_utc").collect()
    assert [r.local_hour for r in rows] == [1, 3, 2, 2]
    assert [r.utc_offset_minutes for r in rows] == [60, 120, 120, 60]
    assert [r.is_dst for r in rows] == [False, True, True, False]
    assert [r.source_row_number for r in rows] == [2, 3, 4, 5]
    assert (rows[0].DD, rows[0].T, rows[0].department, rows[0].year) == (270, 12.5, "44", 2024)
    assert len(rows[0].source_sha256) == 64
    station = read_table(spark, root, "stations").first()
    assert (station.NOM_USUEL, station.name_variant_count, station.source_departments) == ("PORT NEUF", 2, ["44"])
    assert read_table(spark, root, "station_metadata_history").count() == 2
    metric = read_table(spark, root, "metrics").where("source_mnemonic = 'T'").first()
    assert (metric.official_unit_text, metric.english_label, metric.quality_mnemonic) == ("°C", "Air temperature", "QT")
    manifest = read_manifests(spark, root).first()
    assert manifest.materialized_years == [2024]
    assert register_views(spark, root)
    assert spark.sql("select count(*) from hourly_marine").first()[0] == 1
    assert read_table(spark, root, "departments").first().department_name == "Loire-Atlantique"


def test_unchanged_archives_do_nothing(spark, folder):
    archive(folder, "H_44_2020-2024.csv.gz", line("2020010100"))
    assert run(spark, folder).status == "synchronized"
    assert run(spark, folder).status == "up-to-date"
    root = str(folder / "out")
    assert read_table(spark, root, "processing_runs").count() == 1
    assert read_table(spark, root, "hourly_snow").count() == 0


def test_changed_and_removed_archives_touch_only_their_years(spark, folder):
    archive(folder, "H_44_2010-2019.csv.gz", line("2010010100"), line("2012010100"))
    archive(folder, "H_44_2020-2024.csv.gz", line("2020010100"))
    assert run(spark, folder).status == "synchronized"
    root = str(folder / "out")
    before = {p: p.read_bytes() for p in (folder / "out/facts").rglob("year=201*/*.parquet")}
    assert len(before) >= 2
    archive(folder, "H_44_2020-2024.csv.gz", line("2020010100"), line("2021010100"))
    second = run(spark, folder)
    assert second.counts["core_rows"] == 2 and second.plan.years == tuple(range(2020, 2025))
    assert {p: p.read_bytes() for p in before} == before
    (folder / "raw/H_44_2010-2019.csv.gz").unlink()
    third = run(spark, folder)
    assert third.status == "synchronized", third.error
    assert third.plan.removed_files == ("H_44_2010-2019.csv.gz",)
    years = {r.year for r in read_table(spark, root, "hourly_core").select("year").distinct().collect()}
    assert years == {2020, 2021}
    assert [r.filename for r in read_table(spark, root, "source_files").collect()] == ["H_44_2020-2024.csv.gz"]
    station = read_table(spark, root, "stations").first()
    assert station.first_observation_utc.year == 2020


@pytest.mark.parametrize(
    ("bad", "message"),
    [
        ([line("2020010100"), line("2020010100")], "Duplicate station-hour keys: 1"),
        ([line("not-a-time")], "H_44_2020-2024.csv.gz:2: invalid AAAAMMJJHH=not-a-time"),
        ([line("2020010100"), "a;b"], "H_44_2020-2024.csv.gz:3: wrong number of fields"),
        ([line("2020010100", name="")], "missing required NOM_USUEL"),
        ([line("2020010100", value="warm")], "invalid T=warm"),
        ([line("2020010100", value="12d")], "invalid T=12d"),
    ],
)
def test_bad_rows_publish_nothing(spark, folder, bad, message):
    archive(folder, "H_44_2020-2024.csv.gz", line("2020010100", value="1.0"))
    assert run(spark, folder).status == "synchronized"
    facts = {p: p.read_bytes() for p in (folder / "out/facts").rglob("*.parquet")}
    archive(folder, "H_44_2020-2024.csv.gz", *bad)
    result = run(spark, folder)
    assert result.status == "failed" and message in result.error
    assert {p: p.read_bytes() for p in (folder / "out/facts").rglob("*.parquet")} == facts
    failure = spark.read.json(str(folder / "out/metadata/failures" / result.run_id)).first()
    assert message in failure.error


def test_missing_identity_column(spark, folder):
    write_gzip(folder / "raw" / "H_44_2020-2024.csv.gz", ["NUM_POSTE;T", "1;2"])
    result = run(spark, folder)
    assert result.status == "failed" and "missing required columns" in result.error
    assert not (folder / "out/facts").exists()


def test_overseas_and_absent_departments(spark, folder):
    with pytest.raises(ValueError, match="metropolitan"):
        sync.plan_sync(spark, str(folder), str(folder / "out"), "971")
    with pytest.raises(ValueError, match="No verified"):
        sync.plan_sync(spark, str(folder), str(folder / "out"), "44")


def test_version_change_needs_an_explicit_rebuild(spark, folder):
    archive(folder, "H_44_2020-2024.csv.gz", line("2020010100"))
    assert run(spark, folder).status == "synchronized"
    part = next((folder / "out/manifests/department=44").glob("part-*.json"))
    manifest = json.loads(part.read_text())
    manifest["transformation_version"] = "0.9.0"
    for checksum in part.parent.glob(".*.crc"):
        checksum.unlink()
    part.write_text(json.dumps(manifest))
    assert run(spark, folder).status == "schema-rebuild-required"
    assert run(spark, folder, rebuild=True).status == "synchronized"


def test_two_departments_audit_status_and_repair(spark, folder):
    archive(folder, "H_44_2020-2024.csv.gz", line("2020010100"))
    archive(folder, "H_35_2020-2024.csv.gz", line("2020010101", station="35000001"))
    archive(folder, "H_29_2020-2024.csv.gz", line("2020010101", station="29000001"))
    assert run(spark, folder, "44").status == run(spark, folder, "35").status == "synchronized"
    root, raw = str(folder / "out"), str(folder / "raw")
    assert repair.audit_metadata(spark, root).consistent
    assert [r.department for r in read_table(spark, root, "departments").orderBy("department").collect()] == ["35", "44"]
    archive(folder, "H_35_2020-2024.csv.gz", line("2020010101", station="35000001"), line("2020010102", station="35000001"))
    status = repair.dataset_status(spark, raw, root)
    assert [(r.department, r.status) for r in status["departments"].collect()] == [("35", "pending"), ("44", "up-to-date")]
    assert [r.department for r in status["raw_only_departments"].collect()] == ["29"]
    assert (status["fact_departments"], status["failed_runs"]) == (2, 0)
    kept = read_table(spark, root, "departments").where("department = '44'").collect()
    spark.createDataFrame(kept, read_table(spark, root, "departments").schema).coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{root}/dimensions/departments")
    broken = repair.audit_metadata(spark, root)
    assert not broken.consistent and "departments" in broken.issues[0]
    report = repair.repair_metadata(spark, root)
    assert (report["department_count"], report["source_file_count"]) == (2, 2)
    assert repair.audit_metadata(spark, root).consistent
    (folder / "out/facts/hourly_core/department=22").mkdir()
    with pytest.raises(ValueError, match="facts departments differ"):
        repair.repair_metadata(spark, root)


def test_manifest_rules(spark, folder):
    target = folder / "out/manifests"
    target.mkdir(parents=True)
    record = {
        "filename": "F.csv.gz", "department": "44", "period_start": 2020, "period_end": 2024, "size": 1,
        "mtime_ns": 1, "sha256": "x",
    }

    def write(code, **changes):
        body = {"department": code, "source_files": {"F.csv.gz": record | {"department": code}}}
        (target / f"department={code}.json").write_text(json.dumps(body | changes, indent=2))

    write("44")
    assert manifest_problems(read_manifests(spark, str(folder / "out"))).count() == 0
    write("35", department="44")
    write("29", source_files={"OTHER": record | {"department": "29"}})
    write("22", source_files={"F.csv.gz": {"filename": "F.csv.gz", "department": "22"}})
    write("56", source_files=None)
    write("971")
    (target / "department=50.json").write_text("{not json")
    found = {r.department: r.problem for r in manifest_problems(read_manifests(spark, str(folder / "out"))).collect()}
    assert found == {
        "35": "manifest department mismatch", "29": "invalid source record", "22": "incomplete source record",
        "56": "no source_files mapping", "971": "unsupported manifest department", "50": "invalid JSON",
    }


def test_a_missing_root_is_an_error(spark, folder):
    with pytest.raises(FileNotFoundError, match="misspelt"):
        read_table(spark, str(folder / "misspelt"), "stations")
    with pytest.raises(FileNotFoundError, match="hourly_core"):
        read_table(spark, str(folder), "hourly_core")
    assert read_table(spark, str(folder), "hourly_snow").count() == 0


def test_tampered_staging_is_found_before_anything_is_replaced(spark, folder, monkeypatch):
    archive(folder, "H_44_2020-2024.csv.gz", line("2023010100"), line("2024010100"))
    assert run(spark, folder).status == "synchronized"
    live = {p: p.read_bytes() for p in (folder / "out/facts").rglob("*.parquet")}
    archive(folder, "H_44_2020-2024.csv.gz", line("2023010100", "1"), line("2024010100", "1"), line("2024010101", t10="3"))
    whole = tables.stage_facts

    def lossy(facts, target, table):
        staged, written = whole(facts, target, table)
        if table == "hourly_core":
            next(Path(tables.table_path(target, table).removeprefix("file:")).rglob("year=2024/*.parquet")).unlink()
        return facts.sparkSession.read.schema(staged.schema).parquet(tables.table_path(target, table)), written

    monkeypatch.setattr(tables, "stage_facts", lossy)
    result = run(spark, folder)
    assert result.status == "failed" and "hourly_core: source=3, written=3, stored=1" in result.error
    assert {p: p.read_bytes() for p in (folder / "out/facts").rglob("*.parquet")} == live
    monkeypatch.undo()
    assert run(spark, folder).status == "synchronized"
    values = {r.T for r in read_table(spark, str(folder / "out"), "hourly_core").collect()}
    assert values == {1.0, 12.5}


def test_quoted_line_breaks_are_published(spark, folder):
    archive(folder, "H_44_2020-2024.csv.gz", line("2024010100", name='"PORT\nDU SUD"'), line("2024010101"))
    result = run(spark, folder)
    assert result.status == "synchronized", result.error
    rows = read_table(spark, str(folder / "out"), "hourly_core").orderBy("AAAAMMJJHH").collect()
    assert [(r.NOM_USUEL, r.source_row_number) for r in rows] == [("PORT\nDU SUD", 2), ("PORT", 3)]


def test_hot_department_year_spreads_over_files(spark, folder, monkeypatch):
    # One department-year with nearly all rows must not end up in one task.
    monkeypatch.setattr(tables, "FILE_BYTES", "64k")
    schema = fact_schema("hourly_core")
    filled = {
        "department": F.lit("44"), "year": F.when(F.col("id") < 50, 2023).otherwise(2024),
        "NUM_POSTE": F.sha2(F.col("id").cast("string"), 256),
        "observation_time_utc": F.timestamp_seconds(F.col("id") * 60),
    }
    facts = spark.range(0, 40_000, 1, 8).select(
        *[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    tables.replace_fact_partitions(facts, str(folder), "hourly_core", "44", [2022, 2023, 2024])
    root = folder / "facts/hourly_core/department=44"
    assert len(list((root / "year=2024").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(folder / "facts/hourly_core")).count() == 40_000


def test_selections_prune_partitions_and_row_groups(spark, folder):
    schema = fact_schema("hourly_core")
    fixed = {"department": F.lit("44"), "year": F.lit(2024)}
    row = spark.range(1).select(
        *[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    row.write.partitionBy("department", "year").parquet(str(folder / "facts/hourly_core"))
    facts = spark.read.schema(schema).parquet(str(folder / "facts/hourly_core"))
    chosen = Selection("T", dt.date(2025, 1, 1), dt.date(2025, 1, 2), department="44", stations=("S",))
    with settings(spark, maxMetadataStringLength="2000"):
        plan = series.daily_statistics(facts, chosen)._jdf.queryExecution().executedPlan().toString()
    scan = next(text for text in plan.splitlines() if "FileScan" in text or "BatchScan" in text)
    partition, pushed = scan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "department" in partition and "year" in partition
    assert "EqualTo(NUM_POSTE,S)" in pushed or "In(NUM_POSTE" in pushed
    assert "GreaterThanOrEqual(observation_time_utc" in pushed and "IsNotNull(T)" in pushed
    read = scan.split("ReadSchema: ")[1]
    assert "QT" not in read and "U:" not in read and "NOM_USUEL" in read


def test_untouched_partitions_feed_dimensions(spark):
    layout = "department string, year int, NUM_POSTE string"
    published = spark.createDataFrame([("44", 2020, "old"), ("44", 2021, "stale")], layout)
    staged = spark.createDataFrame([("44", 2021, "fresh")], layout)
    affected = staged.select("department", "year").distinct()
    rows = audits.facts_for_dimensions(published, staged, affected).collect()
    assert sorted(r.NUM_POSTE for r in rows) == ["fresh", "old"]


def test_tasks_of_fact_writes_are_bounded_by_rows(spark, folder, monkeypatch):
    # Empty columns compress to nothing, so bytes of a shuffle say little about what a task sorts.
    monkeypatch.setattr(tables, "rows_per_task", lambda: 1000)
    filled = {
        "department": F.lit("44"), "year": F.when(F.col("id") < 4800, 2024).otherwise(2015 + F.col("id") % 8),
        "NUM_POSTE": F.lit("44000001"), "observation_time_utc": F.timestamp_seconds(F.col("id") * 3600),
    }
    facts = spark.range(0, 5000, 1, 4).select(
        *[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fact_schema("hourly_core").fields]
    )
    arranged, years = tables.arrange_facts(facts)
    sizes = [r.n for r in arranged.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert years == {2024, *range(2015, 2023)}
    assert sum(sizes) == 5000 and len(sizes) == 5 and max(sizes) < 1500
    assert arranged.columns == facts.columns
    assert tables.arrange_facts(facts.where("id < 0"))[0].count() == 0


def test_archives_of_many_gzip_members_are_read_whole(spark, folder):
    import gzip

    from stationlake.checks import jobs
    from stationlake.sources.archives import discover_archives, read_archives

    rows = spark.range(0, 3000, 1, 5).select(
        F.lit("H_44_2020-2024.csv.gz").alias("source_file"), F.col("id").alias("place"),
        F.concat_ws(";", F.lit("44000001"), F.col("id").cast("string")).alias("line"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        jobs._write_archives(rows, ("NUM_POSTE", "AAAAMMJJHH"), str(folder / "raw"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    path = folder / "raw/H_44_2020-2024.csv.gz"
    assert path.read_bytes().count(b"\x1f\x8b\x08") > 1
    with gzip.open(path, "rt") as lines:
        assert lines.read().split() == ["NUM_POSTE;AAAAMMJJHH", *[f"44000001;{n}" for n in range(3000)]]
    _, records = read_archives(spark, discover_archives(spark, str(folder / "raw")), str(folder / "staged"))
    assert records.count() == 3001

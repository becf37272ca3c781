"""Catalog parsing and file states."""

from __future__ import annotations

import json

import pytest

from stationlake.operators import reconcile
from stationlake.sources.resources import parse_resources, read_catalog, select_resources

CASES = [
    ("HOR_departement_2A_periode_2010-2019", "https://x.test/file.csv.gz", "2A", 2010, 2019),
    ("HOR_departement_971_periode_2020-2024", "https://x.test/file.csv.gz", "971", 2020, 2024),
    (None, "https://x.test/a/H_988_latest-2025-2026.csv.gz", "988", 2025, 2026),
    ("", "https://x.test/H_44_previous-2020-2024.csv.gz?v=1", "44", 2020, 2024),
    ("Département 2b décennie 1950_1959", "https://x.test/data.csv.gz", "2B", 1950, 1959),
    ("Sans indication", "https://x.test/data.csv.gz", None, None, None),
]


def test_titles_and_names(spark, folder):
    records = [
        {"id": str(n), "title": c[0], "url": c[1], "format": "csv.gz", "type": "main", "filesize": n}
        for n, c in enumerate(CASES)
    ]
    records.append({"id": "d", "title": "Notice", "url": "https://x.test/d.csv.gz", "type": "documentation"})
    records.append({"id": "p", "title": "Page", "url": "https://x.test/page.html", "format": "html"})
    records.append({"id": "u", "title": "Sans nom", "url": "https://x.test", "format": "GZ"})
    path = folder / "catalog.json"
    path.write_text(json.dumps({"resources": records}, indent=1), "utf-8")
    rows = {r.resource_id: r for r in parse_resources(read_catalog(spark, str(path))).collect()}
    assert set(rows) == {*map(str, range(len(CASES))), "u"}
    for n, (_, _, department, start, end) in enumerate(CASES):
        found = rows[str(n)]
        assert (found.department, found.period_start, found.period_end) == (department, start, end)
    assert rows["2"].filename == "H_988_latest-2025-2026.csv.gz"
    assert rows["u"].filename == "u.csv.gz"
    parsed = parse_resources(read_catalog(spark, str(path)))
    assert [r.resource_id for r in select_resources(parsed, {"44"}, 2024, 2025).collect()] == ["3"]
    unbounded = select_resources(parsed).collect()
    assert len(unbounded) == len(CASES) + 1 and unbounded[0].department is None
    assert all(r.period_start for r in select_resources(parsed, None, 1900, None).collect())


@pytest.mark.parametrize(
    ("catalog", "local", "partial", "server", "status", "source", "mismatch", "redundant"),
    [
        (4, None, None, None, "missing", "unavailable", False, False),
        (4, None, 1, None, "partial", "unavailable", False, False),
        (4, 4, None, 99, "complete", "catalog", False, False),
        (4, 4, 4, None, "complete", "catalog", False, True),
        (None, 4, 4, None, "unknown-size", "unavailable", False, True),
        (3, 4, 4, 4, "complete", "server", True, True),
        (3, 5, 5, 4, "invalid", "server", True, False),
        (3, 5, None, 3, "invalid", "server", False, False),
        (3, 5, None, None, "invalid", "catalog", True, False),
    ],
)
def test_states(spark, catalog, local, partial, server, status, source, mismatch, redundant):
    resources = spark.createDataFrame([("F", catalog)], "filename string, expected_size bigint")

    def sized(value):
        return spark.createDataFrame([("F", value)] if value is not None else [], "filename string, size bigint")

    answers = spark.createDataFrame(
        [("F", server, None)], "filename string, server_size bigint, remote_error string"
    )
    row = reconcile.reconcile_files(resources, sized(local), sized(partial), answers).first()
    assert (row.status, row.size_source) == (status, source)
    assert (row.catalog_mismatch, row.redundant_partial) == (mismatch, redundant)
    assert (row.remote_error is not None) == (source == "catalog" and status == "invalid")


def test_patterns_are_searched_once(spark):
    layout = (
        "id string, title string, url string, format string, type string, last_modified string, filesize bigint"
    )
    rows = [
        (str(n), title, f"https://files.test/H_44_{1950 + n}-{1959 + n}-x%20v1.csv.gz", "csv.gz", "main", None, 1)
        for n, title in enumerate(["HOR_departement_35_periode_2001_-_2009", "Horaires 2A décennie 1990 1999", None])
    ]
    parsed = parse_resources(spark.createDataFrame(rows, layout))
    found = {r.resource_id: (r.department, r.period_start, r.period_end, r.filename) for r in parsed.collect()}
    assert found == {
        "0": ("35", 2001, 2009, "H_44_1950-1959-x v1.csv.gz"), "1": ("2A", 1990, 1999, "H_44_1951-1960-x v1.csv.gz"),
        "2": ("44", 1952, 1961, "H_44_1952-1961-x v1.csv.gz"),
    }
    plan = parsed.where("period_start > 1900 AND period_end < 2100")._jdf.queryExecution().optimizedPlan().toString()
    # Once, and once more in the test for a blank match.
    assert plan.count("UrlCodec") <= 1 and plan.count("]cennie") <= 2
    assert [r.resource_id for r in select_resources(parsed, None, 1950, 1960).collect()] == ["2"]
    assert [r.resource_id for r in select_resources(parsed, None, 1950, 1995).collect()] == ["1", "2"]

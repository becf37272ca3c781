"""Corner cases of selections, series, coverage and comparison."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stationlake.operators import coverage, selection, series, stations
from stationlake.operators.selection import ResultTooLarge, Selection
from stationlake.plans import views
from tests.conftest import make_facts

DAY = dt.date(2025, 3, 10)


def select(**changes):
    values = dict(metric="T", start=DAY, end=DAY, department="44", stations=("44000011",))
    return Selection(**(values | changes))


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        ("44", "44000011", "NORD", "2023-03-10 06", -1.0, 1),
        ("44", "44000011", "NORD", "2023-03-10 15", 9.0, 1),
        ("44", "44000011", "NORD", "2024-03-10 06", 3.0, 1),
        ("44", "44000011", "NORD", "2024-03-10 15", 13.0, 2),
        ("44", "44000011", "NORD", "2025-03-10 06", 5.0, 1),
        ("44", "44000011", "NORD", "2025-03-10 15", 8.0, None),
        ("44", "44000011", "NORD", "2024-02-29 12", 7.0, 1),
        ("44", "44000011", "NORD", "2020-02-29 12", 2.0, 9),
        ("44", "44000011", "NORD", "2024-10-27 00", 11.0, 1),
        ("44", "44000011", "NORD", "2024-10-27 01", 10.0, 2),
        ("44", "44000022", "SUD", "2025-03-10 06", 6.0, 1),
        ("44", "44000033", "BORD", "2024-12-31 23", 4.0, 1),
        ("44", "44000044", "VIDE", "2025-03-10 06", None, 1),
        ("35", "35000001", "LOIN", "2025-03-10 06", 1.0, 1),
        ("35", "35000001", "LOIN", "2025-07-01 06", 20.0, 1),
    ]
    return make_facts(spark, rows)


def test_selection_rejects_bad_input():
    with pytest.raises(ValueError, match="no department code"):
        select(department="Bretagne")
    with pytest.raises(ValueError, match="more than the 5 allowed"):
        select(stations=tuple("abcdef"), most_stations=5)
    with pytest.raises(ValueError, match="no department code.*before it begins"):
        select(department="Bretagne", end=dt.date(2025, 3, 9))
    assert len(select(stations=tuple("abcdef")).stations) == 6
    with pytest.raises(ValueError, match="unknown"):
        select(metric="T; DROP")
    with pytest.raises(ValueError, match="has the statistics"):
        select(statistics=("total",))
    with pytest.raises(ValueError, match="before it begins"):
        select(end=dt.date(2025, 3, 9))
    with pytest.raises(ValueError, match="listed twice"):
        select(stations=("a", "a"))
    with pytest.raises(ValueError, match="quality mode"):
        select(quality_mode="best")


def test_hourly_and_daily_values(facts):
    assert [r.value for r in series.hourly_series(facts, select()).collect()] == [5.0, 8.0]
    daily = series.daily_series(facts, select(statistics=("average", "minimum", "maximum"))).collect()
    assert [(r.statistic, r.value) for r in daily] == [("average", 6.5), ("maximum", 8.0), ("minimum", 5.0)]
    rain = select(metric="RR1", statistics=("total",))
    assert series.daily_statistics(facts, rain).first().total == pytest.approx(1.3)


def test_quality_mode_keeps_missing_codes(facts):
    day = dt.date(2024, 3, 10)
    good = select(start=day, end=day, quality_mode="exclude_doubtful")
    assert [r.value for r in series.hourly_series(facts, good).collect()] == [3.0]
    today = select(quality_mode="exclude_doubtful")
    assert series.hourly_series(facts, today).count() == 2


def test_local_day_may_lie_in_the_next_year(facts):
    new_year = select(start=dt.date(2025, 1, 1), end=dt.date(2025, 1, 1), stations=("44000033",))
    assert series.hourly_series(facts, new_year).count() == 1
    in_utc = select(
        start=dt.date(2025, 1, 1), end=dt.date(2025, 1, 1), stations=("44000033",), time_basis="utc"
    )
    assert series.hourly_series(facts, in_utc).count() == 0


def test_clock_changes_in_grid_and_summary(facts):
    autumn = dt.date(2024, 10, 27)
    chosen = select(start=autumn, end=autumn)
    grid = {r.observation_hour: r.observation_count for r in coverage.station_coverage_grid(facts, chosen).collect()}
    assert len(grid) == 24 and grid[2] == 2 and sum(grid.values()) == 2
    summary = coverage.coverage_summary(facts, chosen).first()
    assert (summary.observations, summary.expected) == (2, 25)
    spring = dt.date(2024, 3, 31)
    assert coverage.coverage_summary(facts, select(start=spring, end=spring)).first().expected == 23
    all_stations = coverage.coverage_grid(facts, select(start=autumn, end=autumn, stations=None))
    assert {r.observation_hour: r.observation_count for r in all_stations.collect()} == grid


def test_grid_of_thirty_years_has_every_cell_of_every_seen_station(facts):
    span = select(start=dt.date(1997, 1, 1), end=dt.date(2026, 12, 31), stations=None)
    days = (span.end - span.start).days + 1
    grid = coverage.coverage_grid(facts, span).groupBy("NUM_POSTE").agg(
        F.count("*").alias("cells"), F.count_distinct("observation_date").alias("days"),
        F.sum("observation_count").alias("observations"),
    )
    found = {r.NUM_POSTE: r for r in grid.collect()}
    assert "44000044" not in found and len(found) >= 3
    assert {(r.cells, r.days) for r in found.values()} == {(24 * days, days)}
    rows = facts.where("T IS NOT NULL").where(F.col("department") == "44").groupBy("NUM_POSTE").count().collect()
    for row in rows:
        assert found[row.NUM_POSTE].observations == row["count"]


def test_whole_network_expects_silent_stations(facts):
    day = select(start=dt.date(2025, 3, 10), end=dt.date(2025, 3, 10), stations=None)
    assert coverage.coverage_summary(facts, day).first().expected == 4 * 24
    dimension = facts.sparkSession.createDataFrame([("44", "a"), ("44", "b"), ("35", "c")], "department string, NUM_POSTE string")
    row = coverage.coverage_summary(facts, day, dimension).first()
    assert (row.stations, row.expected) == (2, 48)
    none = select(start=dt.date(1950, 1, 1), end=dt.date(1950, 1, 1), stations=None)
    assert coverage.coverage_summary(facts, none).first().observations == 0


def test_more_than_five_stations_are_validated(facts):
    six = ("44000011", "44000022", "x1", "x2", "x3", "x4")
    chosen = select(stations=None)
    assert views.retain_stations(facts, chosen, six) == ("44000011", "44000022")
    with pytest.raises(ValueError, match="available"):
        views.check_stations(facts, select(stations=six))
    assert views.check_stations(facts, select(stations=six[:2])).stations == six[:2]


def test_hourly_order_follows_instants_in_the_fold(facts):
    autumn = dt.date(2024, 10, 27)
    values = [r.value for r in series.hourly_series(facts, select(start=autumn, end=autumn)).collect()]
    assert values == [11.0, 10.0]


def test_comparison_excludes_exact_dates_only(facts):
    row = series.historical_comparison(facts, select()).first()
    assert (row.selected_average, row.selected_minimum, row.selected_maximum) == (6.5, 5.0, 8.0)
    assert (row.absolute_minimum, row.absolute_maximum) == (-1.0, 13.0)
    assert (row.average_minimum, row.average_maximum) == (1.0, 11.0)
    assert (row.historical_days, row.historical_years) == (2, 2)
    with_selection = series.historical_comparison(facts, select(baseline_excludes_selection=False)).first()
    assert with_selection.historical_days == 3
    assert with_selection.average_minimum == pytest.approx(7 / 3)


def test_comparison_keeps_days_without_data_and_leap_days(facts):
    span = select(start=dt.date(2025, 3, 9), end=dt.date(2025, 3, 10))
    rows = series.historical_comparison(facts, span).collect()
    assert [r.observation_date.day for r in rows] == [9, 10]
    assert rows[0].selected_average is None and rows[0].historical_days is None
    leap = select(start=dt.date(2024, 2, 29), end=dt.date(2024, 2, 29))
    row = series.historical_comparison(facts, leap).first()
    assert (row.absolute_minimum, row.historical_years) == (2.0, 1)


def test_rain_comparison_uses_totals(facts):
    rain = select(metric="RR1", statistics=("total",))
    row = series.historical_comparison(facts, rain).first()
    assert row.selected_total == pytest.approx(1.3)
    assert row.selected_average is None
    assert row.absolute_minimum == pytest.approx(0.8)
    assert row.absolute_maximum == pytest.approx(1.6)
    assert row.historical_average_total == pytest.approx(1.2)


def test_result_limit(facts):
    rows = series.hourly_series(facts, select())
    assert selection.check_result_size(rows, limit=2) is rows
    with pytest.raises(ResultTooLarge, match="narrow the period"):
        selection.check_result_size(rows, limit=1)
    with pytest.raises(ResultTooLarge, match="cells"):
        coverage.coverage_grid(facts, select(), limit=10)


def test_station_map_keeps_silent_stations(facts):
    rows = {r.NUM_POSTE: r for r in coverage.station_map(facts, select(stations=None)).collect()}
    assert set(rows) == {"44000011", "44000022", "44000033", "44000044"}
    assert not rows["44000033"].active_in_period and rows["44000033"].coverage == 0
    assert rows["44000044"].active_in_period and rows["44000044"].metric_rows == 0


def test_overview_weighs_days_equally(spark):
    hours = [f"{h:02d}" for h in range(18)]
    rows = [("44", "S1", "OLD", f"2025-02-01 {h}", 10.0, 1) for h in hours]
    rows += [("44", "S1", "NEW", f"2025-02-02 {h}", 20.0, 1) for h in [*hours, "18", "19"]]
    rows += [("44", "S2", "SPARSE", f"2025-02-01 {h}", 5.0, 1) for h in hours[:17]]
    rows += [("44", "S3", "DOUBT", f"2025-02-01 {h}", 8.0, 2) for h in hours]
    facts = make_facts(spark, rows)
    period = (dt.date(2025, 2, 1), dt.date(2025, 2, 2))
    means = {r.NUM_POSTE: r for r in coverage.temperature_overview(facts, *period).collect()}
    assert set(means) == {"S1", "S3"}
    assert means["S1"].period_mean_temperature == 15.0
    assert (means["S1"].NOM_USUEL, means["S1"].qualifying_days, means["S1"].valid_hours) == ("NEW", 2, 38)
    good = coverage.temperature_overview(facts, *period, quality_mode="exclude_doubtful").collect()
    assert [r.NUM_POSTE for r in good] == ["S1"]
    with pytest.raises(ValueError, match="between 1 and 25"):
        coverage.temperature_overview(facts, *period, minimum_daily_hours=26)


def test_year_ranges_and_best_station(facts):
    assert stations.calendar_year_range(facts, "35", 2025) == (dt.date(2025, 1, 1), dt.date(2025, 7, 1))
    assert stations.calendar_year_range(facts, "44", 2024) == (dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    with pytest.raises(ValueError, match="no observations in 1999"):
        stations.calendar_year_range(facts, "44", 1999)
    best = stations.best_station(facts, select(stations=None)).first()
    assert best.NUM_POSTE == "44000011"


def test_views_defaults_and_fallbacks(spark, facts):
    departments = spark.createDataFrame([("35", "Ille"), ("44", "Loire"), ("01", "Ain")], "department string, department_name string")
    chosen = views.default_selection(facts, departments)
    assert (chosen.department, chosen.stations, chosen.end) == ("44", ("44000011",), DAY)
    kept = views.resolve_period(facts, "44", mode="custom", start=DAY, end=DAY)
    assert (kept["mode"], kept["start"]) == ("custom", DAY)
    fallback = views.resolve_period(facts, "44", mode="custom", start=dt.date(1990, 1, 1), end=dt.date(1990, 1, 2))
    assert (fallback["mode"], fallback["year"]) == ("year", 2025)
    assert views.resolve_period(facts, "99")["year"] is None
    assert views.retain_stations(facts, select(), ("44000022", "nope")) == ("44000022",)
    assert views.retain_stations(facts, select(), ("nope",)) == ("44000011",)
    with pytest.raises(ValueError, match="available"):
        views.check_stations(facts, select(stations=("44000033",)))


def test_exports_and_view_parts(spark, facts, folder):
    parts = views.time_series_view(facts, select(), "daily")
    assert parts["matrix"].columns == ["observation_hour", "2025-03-10"]
    assert parts["matrix"].count() == 24
    path = views.export_historical(facts, select(), str(folder))
    assert path.endswith("meteo_france_44_T_2025-03-10_2025-03-10_historical_comparison.csv")
    assert spark.read.option("header", True).csv(path).count() == 1


def test_department_filters_prune_partitions_and_row_groups(facts):
    rows = selection.filter_observations(facts, select(time_basis="utc"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "observation_time_utc" in plan and "to_date" not in plan.lower()

"""Masks, nearest stations and surfaces against plain loops."""

from __future__ import annotations

import json
import math
import random

import pytest

from stationlake.operators import spatial
from stationlake.sources.boundaries import read_boundaries


def distance(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 6371.0088 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def collection(*features):
    return {
        "type": "FeatureCollection",
        "features": [
            {
                "type": "Feature",
                "properties": {"code": code, "nom": f"N{code}", "region": 84},
                "geometry": {"type": kind, "coordinates": shape},
            }
            for code, kind, shape in features
        ],
    }


SQUARE = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
HOLE = [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6], [0.4, 0.4]]


@pytest.fixture
def read(spark, folder):
    def from_document(document):
        path = folder / "areas.geojson"
        path.write_text(json.dumps(document), "utf-8")
        return read_boundaries(spark, str(path))

    return from_document


def test_boundaries_keep_types_and_text_codes(read):
    rows = {r.code: r for r in read(collection(
        (1, "Polygon", [SQUARE, HOLE]), ("2A", "MultiPolygon", [[SQUARE], [HOLE]])
    )).collect()}
    assert set(rows) == {"1", "2A"} and rows["1"].region == "84"
    assert [len(r.polygons) for r in rows.values()] == [1, 2]


def test_boundaries_reject_bad_documents(read):
    with pytest.raises(ValueError, match="unsupported geometry"):
        read(collection(("1", "Point", [0, 0])))
    with pytest.raises(ValueError, match="missing"):
        read({"type": "FeatureCollection", "features": [
            {"properties": {"code": "1"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}
        ]})
    with pytest.raises(ValueError, match="FeatureCollection"):
        read({"type": "Feature"})


def test_every_document_and_feature_is_judged(spark, folder):
    good = collection(("01", "Polygon", [SQUARE]))
    (folder / "a.json").write_text(json.dumps(good))
    assert read_boundaries(spark, str(folder)).count() == 1
    for text, problem in (
        ('{"type": "FeatureCollection", "features": [', "no valid JSON"), ("{}", "not a GeoJSON"),
        ('{"type": "FeatureCollection"}', "without features"),
        (json.dumps(collection(("02", "Polygon", [[[0, 0], [1], [1, 1]]]))), "coordinates"),
        (json.dumps(collection(("02", "MultiPolygon", [SQUARE]))), "coordinates"),
    ):
        (folder / "b.json").write_text(text)
        with pytest.raises(ValueError, match=f"b.json.*{problem}"):
            read_boundaries(spark, str(folder))


def ring_contains(x, y, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip([ring[-1], *ring[:-1]], ring):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def test_cells_equal_ray_casting_on_random_polygons(read):
    dice = random.Random(3)
    shapes = []
    for n in range(6):
        cx, cy = dice.uniform(-3, 3), dice.uniform(-3, 3)

        def ring(scale):
            points = []
            for k in range(12):
                reach = scale * dice.uniform(0.6, 1.0)
                points.append([cx + reach * math.cos(k * math.pi / 6), cy + reach * math.sin(k * math.pi / 6)])
            return [*points, points[0]]

        shapes.append((str(n), "MultiPolygon", [[ring(1.2), ring(0.4)]]))
    shapes.append(("s", "Polygon", [SQUARE, HOLE]))
    step = 0.05
    expected = set()
    for code, kind, shape in shapes:
        for polygon in shape if kind == "MultiPolygon" else [shape]:
            for i in range(-100, 101):
                for j in range(-100, 101):
                    y, x = round(i * step, 6), round(j * step, 6)
                    if ring_contains(x, y, polygon[0]) and not any(ring_contains(x, y, h) for h in polygon[1:]):
                        expected.add((code, i, j))
    edges = spatial.ring_edges(read(collection(*shapes)))
    cells = spatial.cells_in_polygons(edges, step).collect()
    assert {(r.code, r.lat_index, r.lon_index) for r in cells} == expected
    assert spatial.unique_cells(spatial.cells_in_polygons(edges, step), step).count() == len(
        {(i, j) for _, i, j in expected}
    )


def scattered(dice):
    """Stations spread out, crowded, at one place, around a pole and the date line."""
    places = [(dice.uniform(42, 51), dice.uniform(-5, 8)) for _ in range(150)]
    places += [(48.8 + dice.gauss(0, 0.02), 2.3 + dice.gauss(0, 0.02)) for _ in range(300)]
    places += [(45.0, 3.0)] * 40
    places += [(dice.uniform(88.5, 90), dice.uniform(-180, 180)) for _ in range(40)]
    places += [(dice.uniform(-2, 2), (dice.uniform(179.3, 180.7) + 180) % 360 - 180) for _ in range(60)]
    return [(lat, lon, round(dice.uniform(-5, 30), 2)) for lat, lon in places]


def test_nearest_stations_equal_brute_force(spark):
    dice = random.Random(11)
    stations = scattered(dice)
    points = [(dice.uniform(42, 51), dice.uniform(-5, 8)) for _ in range(200)]
    points += [(48.8 + dice.gauss(0, 0.05), 2.3 + dice.gauss(0, 0.05)) for _ in range(100)]
    points += [(45.0, 3.0), (90.0, 0.0), (89.9, 180.0)]
    points += [(dice.uniform(88, 90), dice.uniform(-180, 180)) for _ in range(20)]
    points += [(dice.uniform(-2, 2), dice.choice([-1, 1]) * dice.uniform(179, 180)) for _ in range(40)]
    frame = spark.createDataFrame([(n, *p) for n, p in enumerate(points)], "point_id int, LAT double, LON double")
    sites = spark.createDataFrame(stations, "LAT double, LON double, value double")
    found = {}
    for row in spatial.nearest_stations(frame, sites).collect():
        found.setdefault(row.point_id, []).append((row.distance_km, row.value))
    estimates = {r.point_id: r.temperature for r in spatial.idw_estimate(frame, sites).collect()}
    for n, (lat, lon) in enumerate(points):
        every = sorted((distance(lat, lon, a, b), v) for a, b, v in stations)
        near = [item for item in every if item[0] <= 75][:8]
        got = sorted(found.get(n, []))
        assert [d for d, _ in got] == pytest.approx([d for d, _ in near], abs=1e-6)
        if every[0][0] < 0.001:
            assert estimates[n] == every[0][1]
        elif len(near) < 3:
            assert estimates[n] is None
        else:
            weights = [1 / (d * d) for d, _ in near]
            mean = sum(w * v for w, (_, v) in zip(weights, near)) / sum(weights)
            assert estimates[n] == pytest.approx(mean, abs=1e-6)


def test_candidate_pairs_stay_near_the_neighbours_wanted(spark):
    """Inside a crowd, 50 km away from one, and between scattered stations."""
    dice = random.Random(2)
    crowd = [(48.8 + dice.gauss(0, 0.02), 2.3 + dice.gauss(0, 0.02)) for _ in range(5000)]
    sites = spark.createDataFrame([(*place, 1.0) for place in crowd], "LAT double, LON double, value double")
    inside = [(48.8 + dice.gauss(0, 0.02), 2.3 + dice.gauss(0, 0.02)) for _ in range(200)]
    away = [(48.8 + 0.45 * math.sin(n), 2.3 + 0.68 * math.cos(n)) for n in range(200)]
    for places in (inside, away):
        points = spark.createDataFrame([(n, *p) for n, p in enumerate(places)], "point_id int, LAT double, LON double")
        pairs = spatial.candidate_pairs(points, spatial.station_sites(sites))
        counted = [r["count"] for r in pairs.groupBy("point_id").count().collect()]
        assert len(counted) == 200 and min(counted) >= 8
        assert sum(counted) <= 6 * 8 * 200


def test_missing_places_find_nothing(spark):
    points = spark.createDataFrame([(1, None, 2.0), (2, 48.0, 2.0), (3, 10.0, 10.0)], "point_id int, LAT double, LON double")
    sites = spark.createDataFrame([(48.0, 2.1, 5.0), (None, 2.0, 1.0), (48.0, 2.0, None)], "LAT double, LON double, value double")
    assert [(r.point_id, r.value) for r in spatial.nearest_stations(points, sites).collect()] == [(2, 5.0)]
    estimates = {r.point_id: r.temperature for r in spatial.idw_estimate(points, sites).collect()}
    assert estimates == {1: None, 2: None, 3: None}


def test_surface_needs_three_stations_and_stays_in_the_area(spark, read):
    area = read(collection(("01", "Polygon", [SQUARE, HOLE])))
    layout = "LAT double, LON double, period_mean_temperature double"
    three = spark.createDataFrame([(0.45, 0.3, 10.0), (0.5, 0.7, 12.0), (0.75, 0.5, 14.0), (None, 0.1, 1.0)], layout)
    cells = spatial.temperature_surface(three, area, 0.25).collect()
    assert cells and all(0 <= c.LAT < 1 and 0 <= c.LON < 1 for c in cells)
    assert (0.5, 0.5) not in {(c.LAT, c.LON) for c in cells}
    assert all(10 <= c.temperature <= 14 for c in cells)
    exact = {(c.LAT, c.LON): c.temperature for c in cells}
    assert (0.75, 0.5) in exact and exact[(0.75, 0.5)] == 14.0
    two = three.limit(2)
    assert spatial.temperature_surface(two, area, 0.25).count() == 0


def test_regions_and_selection(spark, read):
    areas = read(collection(("01", "Polygon", [SQUARE]), ("2A", "Polygon", [SQUARE])))
    codes = spark.createDataFrame([("2A",), ("99",)], "code string")
    assert {r.code: r.region for r in spatial.region_lookup(codes, areas).collect()} == {"2A": "84", "99": None}
    assert [r.code for r in spatial.select_boundaries(areas, ["01"]).collect()] == ["01"]


def test_children_are_judged_in_bounded_pieces_before_they_are_shuffled(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spatial, "MOST_CHILDREN", 100)
    edge = spatial._EDGES[1]
    cells = [[(x << 40 | y << 20 | 400) for x in range(300, 300 + n) for y in range(3)] for n in (1, 40, 10, 0, 12)]
    lists = [[{"cell": cell, "sites": 1} for cell in row] for row in cells]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(5)), pa.array([45.0] * 5), pa.array([1.0] * 5), pa.array(lists, spark_children_type())],
        names=["point_id", "LAT", "LON", "children"],
    )
    parts = list(spatial._cut(batch))
    assert [part.column(0).to_pylist() for part in parts] == [[0], [1], [2, 3, 4]]
    whole = [r for part in spatial._closer_cells(edge, 8)([batch]) for r in part.to_pylist()]
    monkeypatch.setattr(spatial, "MOST_CHILDREN", 1 << 17)
    assert whole == [r for part in spatial._closer_cells(edge, 8)([batch]) for r in part.to_pylist()]
    points = spark.createDataFrame([(1, 45.0, 1.0)], "point_id int, LAT double, LON double")
    sites = spark.createDataFrame([(45.1, 1.0, 1.0)], "LAT double, LON double, value double")
    plan = spatial.candidate_cells(points, sites, 1)._jdf.queryExecution().optimizedPlan().toString()
    # The first cubes, the children of each cube alone, and those of a point together.
    assert plan.count("MapInArrow") == 3


def spark_children_type():
    import pyarrow as pa

    return pa.list_(pa.struct([("cell", pa.int64()), ("sites", pa.int64())]))

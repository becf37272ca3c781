"""Checks of boundaries, grids, nearest stations and surfaces against brute force."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stationlake.checks.observations import OVERVIEW_SQL
from stationlake.checks.registry import query, rounded
from stationlake.operators import coverage, spatial
from stationlake.session import stored

STEP = 0.1
EDGES = """
    rings AS (SELECT code, p.polygon, r.ring, r.points FROM boundaries,
              LATERAL (SELECT unnest(polygons) AS rings, unnest(range(len(polygons))) AS polygon) p,
              LATERAL (SELECT unnest(p.rings) AS points, unnest(range(len(p.rings))) AS ring) r),
    edges AS (SELECT code, polygon, ring, points[CASE WHEN i = 1 THEN len(points) ELSE i - 1 END][1] AS x1,
                     points[CASE WHEN i = 1 THEN len(points) ELSE i - 1 END][2] AS y1,
                     points[i][1] AS x2, points[i][2] AS y2
              FROM (SELECT *, unnest(range(1, len(points) + 1)) AS i FROM rings))
    """
BOUNDS = """
    bounds AS (SELECT code, min(x2) AS min_lon, min(y2) AS min_lat, max(x2) AS max_lon, max(y2) AS max_lat
               FROM edges GROUP BY 1)
    """
GRID = f"""
    grid AS (SELECT code, lat_index, lon_index, round(lat_index * {STEP}e0, 6) AS LAT,
                    round(lon_index * {STEP}e0, 6) AS LON
             FROM (SELECT code, lat_index, min_lon, max_lon,
                          unnest(range(cast(floor(min_lon / {STEP}e0) AS bigint),
                                       cast(ceil(max_lon / {STEP}e0) AS bigint) + 1)) AS lon_index
                   FROM (SELECT *, unnest(range(cast(floor(min_lat / {STEP}e0) AS bigint),
                                                cast(ceil(max_lat / {STEP}e0) AS bigint) + 1)) AS lat_index
                         FROM bounds)))
    """
INSIDE = """
    hits AS (SELECT g.code, polygon, ring, lat_index, lon_index, count(*) % 2 AS odd
             FROM grid g JOIN edges e ON e.code = g.code AND (e.y1 > LAT) <> (e.y2 > LAT)
                  AND LON < (x2 - x1) * (LAT - y1) / (y2 - y1) + x1 GROUP BY ALL),
    inside AS (SELECT DISTINCT code, lat_index, lon_index FROM hits o WHERE ring = 0 AND odd = 1 AND NOT EXISTS
               (SELECT 1 FROM hits h WHERE h.ring > 0 AND h.odd = 1 AND h.code = o.code AND h.polygon = o.polygon
                AND h.lat_index = o.lat_index AND h.lon_index = o.lon_index)),
    cells AS (SELECT DISTINCT lat_index, lon_index, round(lat_index * 0.1e0, 6) AS LAT,
                     round(lon_index * 0.1e0, 6) AS LON FROM inside)
    """
DISTANCE = (
    "6371.0088e0 * 2 * atan2(sqrt(h), sqrt(1 - h))",
    "pow(sin(radians(s.LAT - p.LAT) / 2), 2) + cos(radians(p.LAT)) * cos(radians(s.LAT)) "
    "* pow(sin(radians(s.LON - p.LON) / 2), 2)",
)


def _nearest_sql(points: str, key: str) -> str:
    return f"""
    pairs AS (SELECT {key}, value, {DISTANCE[0]} AS d
              FROM (SELECT {key}, s.value, {DISTANCE[1]} AS h FROM {points} p CROSS JOIN sites s)),
    near AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY d, value) AS place
             FROM pairs WHERE d <= 75)
    """


def _estimate_sql(key: str) -> str:
    return f"""
    est AS (SELECT {key}, CASE WHEN min(d) < 1e-3 THEN arg_min(value, place) WHEN count(*) >= 3
                   THEN sum(value / (d * d)) / sum(1 / (d * d)) END AS temperature
            FROM near WHERE place <= 8 GROUP BY {key})
    """


SITES = (
    f"means AS ({OVERVIEW_SQL.strip()}), "
    "sites AS (SELECT LAT, LON, period_mean_temperature AS value FROM means)"
)


def _means(t):
    means = coverage.temperature_overview(
        t.obs, dt.date(2024, 1, 1), dt.date(2024, 1, 31), quality_mode="exclude_doubtful",
        minimum_daily_hours=2,
    )
    return rounded(means, "period_mean_temperature")


def _sites(t):
    """Station means, stored once because a neighbour search uses them twice."""
    means = _means(t).select("LAT", "LON", F.col("period_mean_temperature").alias("value"))
    return stored(means, "stations")


@query(
    "boundary_edges",
    f"WITH {EDGES} SELECT code, cast(polygon AS int) AS polygon, cast(ring AS int) AS ring, x1, y1, x2, y2 FROM edges",
    ("boundaries",),
)
def boundary_edges(t):
    return spatial.ring_edges(t.view("boundaries"))


@query("boundary_bounds", f"WITH {EDGES}, {BOUNDS} SELECT * FROM bounds", ("boundaries",))
def boundary_bounds(t):
    return spatial.boundary_bounds(spatial.ring_edges(t.view("boundaries")))


@query("grid_cells", f"WITH {EDGES}, {BOUNDS}, {GRID} SELECT * FROM grid", ("boundaries",))
def grid_cells(t):
    return spatial.grid_cells(spatial.boundary_bounds(spatial.ring_edges(t.view("boundaries"))), STEP)


@query(
    "point_in_polygon_join",
    f"WITH {EDGES}, {BOUNDS}, {GRID}, {INSIDE} SELECT code, lat_index, lon_index FROM inside",
    ("boundaries",),
)
def point_in_polygon_join(t):
    return spatial.cells_in_polygons(spatial.ring_edges(t.view("boundaries")), STEP)


@query(
    "dedupe_cells",
    f"WITH {EDGES}, {BOUNDS}, {GRID}, {INSIDE} SELECT * FROM cells",
    ("boundaries",),
)
def dedupe_cells(t):
    return spatial.unique_cells(spatial.cells_in_polygons(spatial.ring_edges(t.view("boundaries")), STEP), STEP)


NEAREST_SQL = f"""
    WITH {SITES}, {_nearest_sql('points', 'point_id')}
    SELECT point_id, round(d, 6) AS distance_km, value, cast(place AS int) AS place FROM near WHERE place <= 8
    """


@query("nearest_stations_join", NEAREST_SQL, ("obs", "points"))
def nearest_stations_join(t):
    return rounded(spatial.nearest_stations(t.view("points"), _sites(t)), "distance_km", digits=6)


@query(
    "top8_per_point",
    f"""WITH {SITES}, {_nearest_sql('points', 'point_id')}
        SELECT point_id, count(*) AS neighbours, round(max(d), 6) AS farthest FROM near WHERE place <= 8 GROUP BY 1""",
    ("obs", "points"),
)
def top8_per_point(t):
    near = spatial.nearest_stations(t.view("points"), _sites(t))
    counted = near.groupBy("point_id").agg(
        F.count("*").alias("neighbours"), F.max("distance_km").alias("farthest")
    )
    return rounded(counted, "farthest", digits=6)


@query(
    "idw_estimate",
    f"""WITH {SITES}, {_nearest_sql('points', 'point_id')}, {_estimate_sql('point_id')}
        SELECT point_id, LAT, LON, round(temperature, 6) AS temperature
        FROM points LEFT JOIN est USING (point_id)""",
    ("obs", "points"),
)
def idw_estimate(t):
    return rounded(spatial.idw_estimate(t.view("points"), _sites(t)), "temperature", digits=6)


@query(
    "temperature_surface",
    f"""WITH {EDGES}, {BOUNDS}, {GRID}, {INSIDE}, {SITES},
        {_nearest_sql('cells', 'lat_index, lon_index')}, {_estimate_sql('lat_index, lon_index')}
        SELECT LAT, LON, round(temperature, 6) AS temperature FROM cells JOIN est USING (lat_index, lon_index)
        WHERE temperature IS NOT NULL""",
    ("boundaries", "obs"),
)
def temperature_surface(t):
    surface = spatial.temperature_surface(_means(t), t.view("boundaries"), STEP)
    return rounded(surface, "temperature", digits=6)


@query(
    "region_lookup",
    """SELECT cast(c_custkey AS varchar) AS code, b.region FROM customer
       LEFT JOIN boundaries b ON b.code = cast(c_custkey AS varchar)""",
    ("boundaries",),
)
def region_lookup(t):
    departments = t.table("customer").select(F.col("c_custkey").cast("string").alias("code"))
    return spatial.region_lookup(departments, t.view("boundaries"))


@query(
    "select_boundaries",
    """SELECT code, nom FROM boundaries WHERE code IN (SELECT cast(n_nationkey AS varchar) FROM nation)""",
    ("boundaries",),
)
def select_boundaries(t):
    codes = t.table("nation").select(F.col("n_nationkey").cast("string").alias("code"))
    return spatial.select_boundaries(t.view("boundaries"), codes).select("code", "nom")

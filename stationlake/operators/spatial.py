"""Boundary masks, nearest stations and inverse-distance surfaces.

Everything joins on computed keys.  Polygons become crossings per grid latitude
(a scan line), so cells are generated between two crossings instead of being
tested against every edge.  Nearest stations are found by going down a pyramid of
cells with station counts, which bounds how far a point's neighbours can be, so
neither a crowded place nor a crowd within reach pairs points with all its stations.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from stationlake.functions.spatial import EARTH_RADIUS_KM, haversine_km
from stationlake.session import stored

GRID_DEGREES = 0.05
NEIGHBOURS = 8
RADIUS_KM = 75.0
MINIMUM_STATIONS = 3
SAME_PLACE_KM = 0.001


# --------------------------------------------------------------------- polygons
def ring_edges(boundaries: DataFrame) -> DataFrame:
    """Edges of every ring; ``ring`` 0 is the outline, others are holes."""
    polygons = boundaries.select("code", F.posexplode("polygons").alias("polygon", "rings"))
    rings = polygons.select("code", "polygon", F.posexplode("rings").alias("ring", "points"))
    # Each point with its predecessor; the first one follows the last.
    before = F.concat(
        F.slice("points", F.size("points"), F.lit(1)),
        F.slice("points", F.lit(1), F.size("points") - 1),
    )
    edge = F.explode(F.arrays_zip(before.alias("a"), F.col("points").alias("b")))
    return rings.select("code", "polygon", "ring", edge.alias("edge")).select(
        "code",
        "polygon",
        "ring",
        F.col("edge.a")[0].alias("x1"),
        F.col("edge.a")[1].alias("y1"),
        F.col("edge.b")[0].alias("x2"),
        F.col("edge.b")[1].alias("y2"),
    )


def boundary_bounds(edges: DataFrame) -> DataFrame:
    """Bounding box per boundary."""
    return edges.groupBy("code").agg(
        F.min("x2").alias("min_lon"),
        F.min("y2").alias("min_lat"),
        F.max("x2").alias("max_lon"),
        F.max("y2").alias("max_lat"),
    )


def grid_coordinate(index: Column, step: float) -> Column:
    return F.round(index * F.lit(step), 6)


def grid_cells(bounds: DataFrame, step: float = GRID_DEGREES) -> DataFrame:
    """All grid points of the bounding boxes."""

    def indices(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / step), F.ceil(F.col(high) / step)))

    rows = bounds.withColumn("lat_index", indices("min_lat", "max_lat"))
    cells = rows.withColumn("lon_index", indices("min_lon", "max_lon"))
    return cells.select(
        "code",
        "lat_index",
        "lon_index",
        grid_coordinate(F.col("lat_index"), step).alias("LAT"),
        grid_coordinate(F.col("lon_index"), step).alias("LON"),
    )


def _scan_line_cells(edges: DataFrame, step: float) -> DataFrame:
    """Grid points with an odd number of crossings to their right, per ring."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # One index of slack on both sides, since grid coordinates are rounded.
    lines = edges.where("y1 <> y2").withColumn(
        "lat_index", F.explode(F.sequence(F.floor(low / step) - 1, F.ceil(high / step) + 1))
    )
    lat = grid_coordinate(F.col("lat_index"), step)
    crossing = (F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    ring = ["code", "polygon", "ring", "lat_index"]
    crossings = lines.where((F.col("y1") > lat) != (F.col("y2") > lat)).select(
        *ring, crossing.alias("enter")
    )
    # A closed ring crosses a line an even number of times: inside is every
    # second gap.  A group holds the crossings of one ring with one line.
    along = Window.partitionBy(*ring).orderBy("enter")
    gaps = crossings.select(
        *ring, "enter", F.lead("enter").over(along).alias("leave"), F.row_number().over(along).alias("n")
    ).where("n % 2 = 1 and leave > enter")
    inside = gaps.withColumn(
        "lon_index",
        F.explode(F.sequence(F.floor(F.col("enter") / step) - 1, F.ceil(F.col("leave") / step) + 1)),
    )
    lon = grid_coordinate(F.col("lon_index"), step)
    return inside.where((lon >= F.col("enter")) & (lon < F.col("leave"))).select(*ring, "lon_index")


def cells_in_polygons(edges: DataFrame, step: float = GRID_DEGREES) -> DataFrame:
    """Grid points inside the outline and outside the holes of a polygon, per boundary."""
    cells = _scan_line_cells(edges, step)
    key = ["code", "polygon", "lat_index", "lon_index"]
    outline = cells.where("ring = 0").select(*key)
    holes = cells.where("ring > 0").select(*key)
    return outline.join(holes, key, "left_anti").select("code", "lat_index", "lon_index").distinct()


def unique_cells(cells: DataFrame, step: float = GRID_DEGREES) -> DataFrame:
    """Each grid point once, whichever boundaries contain it."""
    return cells.select("lat_index", "lon_index").distinct().select(
        "lat_index",
        "lon_index",
        grid_coordinate(F.col("lat_index"), step).alias("LAT"),
        grid_coordinate(F.col("lon_index"), step).alias("LON"),
    )


# ------------------------------------------------------------- nearest stations
# Cells are cubes around the earth's centre, so poles and the date line are places like any other.  Each
# level cuts a cube into 8 x 8 x 8; the coarsest is wider than a search reaches to both sides, so eight cubes hold it.
CUBE_BITS = 3
LEVELS = 5
COARSEST_KM = 160.0
_EDGES = [COARSEST_KM / 2 ** (CUBE_BITS * level) for level in range(LEVELS)]
# Distances are compared as straight lines through the earth; a millimetre covers rounding.
_REACH = 2 * EARTH_RADIUS_KM * math.sin(RADIUS_KM / (2 * EARTH_RADIUS_KM)) + 1e-6
_AXIS_BITS = 20
_AXIS_MASK = (1 << _AXIS_BITS) - 1
# Children that a task looks at in one go; rows are cut accordingly.
MOST_CHILDREN = 1 << 17
CHILDREN = ArrayType(StructType([StructField("cell", LongType()), StructField("sites", LongType())]))


def _with_axes(frame: DataFrame) -> DataFrame:
    """Straight coordinates in km of LAT/LON, from the corner of a cube around the earth."""
    lat, lon = F.radians("LAT"), F.radians("LON")
    straight = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    return frame.withColumns({axis: (value + 1) * EARTH_RADIUS_KM for axis, value in straight.items()})


def _cell(x: Column, y: Column, z: Column, edge: float) -> Column:
    """Number of the cube of a level that holds a place."""
    return sum(
        (F.shiftleft(F.floor(value / edge).cast("bigint"), _AXIS_BITS * n) for n, value in enumerate((y, x), 1)),
        F.floor(z / edge).cast("bigint"),
    )


def _parent(cell: Column) -> Column:
    """The cube of the next coarser level around a cube."""
    parts = (F.shiftright(F.shiftright(cell, _AXIS_BITS * n).bitwiseAND(_AXIS_MASK), CUBE_BITS) for n in range(3))
    return sum((F.shiftleft(part, _AXIS_BITS * n) for n, part in enumerate(parts)), F.lit(0).cast("bigint"))


def station_sites(stations: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Stations with a place and a value, at most ``neighbours`` per place.

    Neighbours are ordered by distance, then value, so of stations at the very
    same place only the lowest values can ever be used.
    """
    usable = stations.where(
        F.col("LAT").isNotNull() & F.col("LON").isNotNull() & F.col("value").isNotNull()
    )
    place = Window.partitionBy("LAT", "LON").orderBy("value")
    ranked = usable.select("LAT", "LON", "value", F.row_number().over(place).alias("n"))
    return ranked.where(F.col("n") <= neighbours).drop("n")


def pyramid_depth(sites: DataFrame, neighbours: int = NEIGHBOURS) -> int:
    """The coarsest level below the top at which no cube holds more sites than are wanted (else the finest).

    One number per level reaches the driver.
    """
    levels = range(1, LEVELS)
    cells = F.array(*[F.struct(F.lit(n).alias("level"), _cell(F.col("x"), F.col("y"), F.col("z"), _EDGES[n]).alias("cell")) for n in levels])
    counts = _with_axes(sites).select(F.explode(cells).alias("at")).groupBy("at.level", "at.cell").count()
    deepest = counts.where(F.col("count") > neighbours).agg(F.max("level").alias("level")).first().level
    return 1 if deepest is None else min(deepest + 1, LEVELS - 1)


def site_pyramid(sites: DataFrame, depth: int) -> list[DataFrame]:
    """Per level above ``depth``: every occupied cube with its occupied cubes of the next level and their counts.

    A cube has at most 512 children, so a row is bounded however crowded it is.
    """
    finest = _cell(F.col("x"), F.col("y"), F.col("z"), _EDGES[depth])
    counts = _with_axes(sites).groupBy(finest.alias("cell")).agg(F.count("*").alias("sites"))
    levels: list[DataFrame] = []
    for _ in range(depth):
        parents = counts.groupBy(_parent(F.col("cell")).alias("cell")).agg(
            F.collect_list(F.struct("cell", "sites")).alias("children"), F.sum("sites").alias("sites")
        )
        levels.insert(0, parents.select("cell", "children"))
        counts = parents.select("cell", "sites")
    return levels


def _straight(batch: pa.RecordBatch) -> np.ndarray:
    """The straight coordinates of (key, LAT, LON, ...), one row per axis."""
    lat, lon = np.radians(batch.column(1).to_numpy()), np.radians(batch.column(2).to_numpy())
    straight = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    return (straight + 1) * EARTH_RADIUS_KM


def _first_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, LAT, LON) to the coarsest cubes around each place.

    The corners of the reach lie in at most eight cubes, and all of the reach within those.
    """
    for batch in batches:
        axes = _straight(batch)
        ends = np.floor(np.stack([axes - _REACH, axes + _REACH]) / _EDGES[0]).astype(np.int64)
        rows, cells = [], []
        for x, y, z in itertools.product((0, 1), repeat=3):
            cell = ends[x, 0] << 2 * _AXIS_BITS | ends[y, 1] << _AXIS_BITS | ends[z, 2]
            # A side whose ends share a cube is counted once.
            new = np.ones(batch.num_rows, bool)
            for side, axis in ((x, 0), (y, 1), (z, 2)):
                new &= (ends[side, axis] != ends[0, axis]) | (side == 0)
            rows.append(np.flatnonzero(new))
            cells.append(cell[new])
        row, cell = np.concatenate(rows), np.concatenate(cells)
        # Beyond the corner of the cube around the earth nothing is.
        inside = (np.stack([cell >> 2 * _AXIS_BITS, cell >> _AXIS_BITS & _AXIS_MASK, cell & _AXIS_MASK]) >= 0).all(axis=0)
        row, cell = row[inside], cell[inside]
        taken = [column.take(pa.array(row)) for column in batch.columns]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(cell)], names=[*batch.schema.names, "cell"])


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with at most ``MOST_CHILDREN`` children together (or one row)."""
    seen = np.cumsum(pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
    start, before = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(seen, before + MOST_CHILDREN, "right")))
        yield batch.slice(start, end - start)
        start, before = end, int(seen[end - 1])


def _closer_cells(edge: float, neighbours: int):
    """(key, LAT, LON, children) with only the children that may hold one of the nearest sites of a row's place.

    Cubes by their farthest corner: once they hold enough sites together, no nearest site
    is farther than that corner, and cubes that begin beyond it are out.  Rows without children left go.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _cut(whole)):
            lists, axes = batch.column(3), _straight(batch)
            flat = lists.flatten()
            cell = flat.field("cell").to_numpy(zero_copy_only=False)
            sites = flat.field("sites").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            near, far = np.zeros(len(cell)), np.zeros(len(cell))
            for n, axis in enumerate(reversed(axes)):
                index = (cell >> _AXIS_BITS * n) & _AXIS_MASK
                start = index * edge - axis[row]
                near += np.maximum(np.maximum(start, -start - edge), 0) ** 2
                far += np.maximum(start + edge, -start) ** 2
            order = np.lexsort((far, row))
            order = order[near[order] <= _REACH**2]
            cell, sites, row, near, far = cell[order], sites[order], row[order], near[order], far[order]
            seen = np.cumsum(sites)
            starts = np.searchsorted(row, row, "left")
            seen = seen - (seen[starts] - sites[starts])
            bound = np.full(batch.num_rows, _REACH**2)
            enough = (seen >= neighbours) & (seen - sites < neighbours)
            bound[row[enough]] = np.minimum(far[enough], _REACH**2)
            kept = near <= (np.sqrt(bound[row]) + 1e-6) ** 2
            rows, sizes = np.unique(row[kept], return_counts=True)
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            children = pa.StructArray.from_arrays([pa.array(cell[kept]), pa.array(sites[kept])], names=["cell", "sites"])
            taken = [batch.column(at).take(pa.array(rows)) for at in range(3)]
            yield pa.RecordBatch.from_arrays([*taken, pa.ListArray.from_arrays(ends, children)], names=batch.schema.names)

    return run


def candidate_cells(
    points: DataFrame, sites: DataFrame, depth: int, key: str = "point_id", neighbours: int = NEIGHBOURS
) -> DataFrame:
    """Per point the cubes of level ``depth`` that may hold its nearest sites within the radius.

    From level to level a point keeps the cubes within the distance that its nearest sites cannot exceed, and goes on
    with their children.  Cubes shrink as the bound does, so a point keeps a few of them at every level,
    whether sites are dense where it is, or dense somewhere within the radius.  The children of one cube bound the
    distance already, so only those within it are shuffled to the point's other ones.
    """
    placed = points.where("LAT IS NOT NULL AND LON IS NOT NULL").select(
        key, F.col("LAT").cast("double").alias("LAT"), F.col("LON").cast("double").alias("LON")
    )
    place = placed.columns
    at_cell = StructType([*placed.schema.fields, StructField("cell", LongType())])
    with_children = StructType([*placed.schema.fields, StructField("children", CHILDREN)])
    found = placed.mapInArrow(_first_cells, at_cell)
    for level, parents in enumerate(site_pyramid(sites, depth), 1):
        closer = _closer_cells(_EDGES[level], neighbours)
        own = found.join(parents, "cell").select(*place, "children").mapInArrow(closer, with_children)
        met = own.groupBy(*place).agg(F.flatten(F.collect_list("children")).alias("children"))
        kept = met.mapInArrow(closer, with_children)
        found = kept.select(*place, F.explode("children.cell").alias("cell"))
    return found


def candidate_pairs(
    points: DataFrame, sites: DataFrame, key: str = "point_id", neighbours: int = NEIGHBOURS
) -> DataFrame:
    """Points with the sites of their candidate cubes: few more than the nearest ones."""
    depth = pyramid_depth(sites, neighbours)
    located = _with_axes(sites).select(
        _cell(F.col("x"), F.col("y"), F.col("z"), _EDGES[depth]).alias("cell"),
        F.col("LAT").alias("site_lat"), F.col("LON").alias("site_lon"), "value",
    )
    return candidate_cells(points, sites, depth, key, neighbours).join(located, "cell").select(
        key, "LAT", "LON", "site_lat", "site_lon", "value"
    )


def nearest_stations(
    points: DataFrame, stations: DataFrame, key: str = "point_id", neighbours: int = NEIGHBOURS
) -> DataFrame:
    """The nearest stations within the radius per point, ``place`` 1 the closest.

    ``points`` has a unique ``key``, LAT, LON; ``stations`` has LAT, LON, value.
    """
    pairs = candidate_pairs(points, station_sites(stations, neighbours), key, neighbours).withColumn(
        "distance_km", haversine_km(F.col("LAT"), F.col("LON"), F.col("site_lat"), F.col("site_lon"))
    )
    # The rank limit prunes every task's candidates before they are shuffled.
    order = Window.partitionBy(key).orderBy("distance_km", "value")
    return (
        pairs.where(F.col("distance_km") <= RADIUS_KM)
        .select(key, "distance_km", "value", F.row_number().over(order).alias("place"))
        .where(F.col("place") <= neighbours)
    )


def weigh_neighbours(nearest: DataFrame, key: str = "point_id") -> DataFrame:
    """Inverse-square-distance mean of the neighbours of each point.

    A station within a metre gives its own value; fewer than three stations in
    reach give NULL.
    """
    distance = F.col("distance_km")
    square = F.nullif(distance * distance, F.lit(0.0))
    exact = F.min(F.when((F.col("place") == 1) & (distance < SAME_PLACE_KM), F.col("value")))
    mean = F.sum(F.col("value") / square) / F.sum(F.lit(1.0) / square)
    return nearest.groupBy(key).agg(
        F.when(exact.isNotNull(), exact)
        .when(F.count("*") >= MINIMUM_STATIONS, mean)
        .alias("temperature")
    )


def idw_estimate(points: DataFrame, stations: DataFrame, key: str = "point_id") -> DataFrame:
    """Estimated value per point, NULL where too few stations are near."""
    estimates = weigh_neighbours(nearest_stations(points, stations, key), key)
    return points.join(estimates, key, "left")


def temperature_surface(
    stations: DataFrame, boundaries: DataFrame, step: float = GRID_DEGREES
) -> DataFrame:
    """Estimated temperatures on the grid points inside the boundaries.

    ``stations`` is a temperature overview.  With fewer than three usable
    stations overall there is no surface.
    """
    values = stations.select("LAT", "LON", F.col("period_mean_temperature").alias("value"))
    usable = values.where("LAT is not null and LON is not null and value is not null")
    # Both sides are used more than once below and far smaller than their sources.
    sites = stored(usable, "surface-stations")
    if len(sites.take(MINIMUM_STATIONS)) < MINIMUM_STATIONS:
        return stations.sparkSession.createDataFrame([], "LAT double, LON double, temperature double")
    cells = unique_cells(cells_in_polygons(ring_edges(boundaries), step), step)
    points = stored(
        cells.select(F.struct("lat_index", "lon_index").alias("point_id"), "LAT", "LON"), "surface-points"
    )
    surface = idw_estimate(points, sites)
    return surface.where("temperature is not null").select("LAT", "LON", "temperature")


# ------------------------------------------------------------------- lookups
def select_boundaries(boundaries: DataFrame, codes) -> DataFrame:
    """Boundaries of the given department codes (any DataFrame with ``code``, or a list)."""
    if isinstance(codes, DataFrame):
        return boundaries.join(codes, "code", "left_semi")
    return boundaries.where(F.col("code").isin([str(code) for code in codes]))


def region_lookup(departments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Region code of each department; NULL where no boundary names it."""
    regions = boundaries.select("code", "region")
    return departments.join(regions, "code", "left")

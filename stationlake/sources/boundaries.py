"""Administrative boundaries from GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "type string, features array<struct<properties: struct<code: string, nom: string, region: string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)
POLYGON = "array<array<array<double>>>"
KINDS = ("Polygon", "MultiPolygon")


def document_problems(documents: DataFrame) -> DataFrame:
    """File and problem of every document that is no feature collection."""
    problem = (
        F.when(F.col("broken").isNotNull(), "the text is no valid JSON")
        .when(~F.coalesce(F.col("type") == "FeatureCollection", F.lit(False)), "not a GeoJSON FeatureCollection")
        .when(F.col("features").isNull(), "a FeatureCollection without features")
    )
    return documents.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def feature_problems(features: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """File, place and problem of every feature that is no boundary, so that none is lost silently."""
    missing = F.greatest(*[F.col(name).isNull().cast("int") for name in needed]) == 1
    problem = (
        F.when(missing, F.lit("feature is missing one of: " + ", ".join(needed)))
        .when(~F.coalesce(F.col("type").isin(*KINDS), F.lit(False)), F.lit("unsupported geometry"))
        .when(~F.coalesce(_complete(F.col("polygons")), F.lit(False)), F.lit("coordinates are no polygons"))
    )
    return features.select("file", "place", problem.alias("problem")).where("problem IS NOT NULL")


def _complete(polygons: Column) -> Column:
    """Whether all rings have points, and all points two coordinates."""
    point = lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()
    ring = lambda r: (F.size(r) > 0) & F.forall(r, lambda p: F.coalesce(point(p), F.lit(False)))
    rings = lambda rs: (F.size(rs) > 0) & F.forall(rs, lambda r: F.coalesce(ring(r), F.lit(False)))
    return (F.size(polygons) > 0) & F.forall(polygons, lambda rs: F.coalesce(rings(rs), F.lit(False)))


def read_boundaries(spark: SparkSession, path: str, with_region: bool = True) -> DataFrame:
    """Features as code, nom, region and an array of polygons (arrays of rings).

    Every document is judged before its features are used: a broken one beside a valid one is an error that
    names its file.  Coordinates arrive as text because their nesting depends on the type.
    """
    reader = spark.read.schema(DOCUMENT + ", broken string").option("multiLine", True)
    documents = reader.option("columnNameOfCorruptRecord", "broken").json(path).select(
        "*", F.col("_metadata.file_name").alias("file")
    )
    listed = documents.select("file", F.posexplode("features").alias("place", "feature"))
    flat = listed.select("file", "place", "feature.properties.*", "feature.geometry.*")
    single = F.array(F.from_json("coordinates", POLYGON))
    several = F.from_json("coordinates", f"array<{POLYGON}>")
    features = flat.withColumn("polygons", F.when(F.col("type") == "Polygon", single).otherwise(several))
    needed = ("code", "nom", "region") if with_region else ("code", "nom")
    first = document_problems(documents).orderBy("file").take(1)
    first = first or feature_problems(features, needed).orderBy("file", "place").take(1)
    if first:
        raise ValueError(f"Administrative geography file {first[0].file} in {path}: {first[0].problem}")
    return features.select("code", "nom", "region", "polygons")

"""The published resource catalog: parsing and selection (no network access)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.values import blank_to_null
from stationlake.operators.selection import periods_overlap
from stationlake.session import stored

CATALOG = (
    "resources array<struct<id: string, title: string, url: string, format: string, type: string, "
    "last_modified: string, filesize: bigint>>"
)

# How titles and file names state department and period.
DEPARTMENT_PATTERNS = (
    r"(?iu)departement[_\s-]*(2A|2B|\d{2,3})",
    r"(?iu)d[ée]partement[_\s-]*(2A|2B|\d{2,3})",
    r"(?iu)horaires?[_\s-]+(2A|2B|\d{2,3})(?=[_\s-])",
    r"(?iu)(?:^|\s)H[_\s-]+(2A|2B|\d{2,3})(?=[_\s-])",
)
PERIOD_PATTERNS = (
    r"(?iu)p[ée]riode[_\s-]*(\d{4})[_\s-]+(\d{4})",
    r"(?iu)d[ée]cennie[_\s-]*(\d{4})[_\s-]+(\d{4})",
    r"(?iu)(?:^|[_\s-])(\d{4})[_\s-]+(\d{4})(?=\D|$)",
)


def file_name(url: Column, identifier: Column) -> Column:
    """Last path part of a URL, decoded; the identifier where there is none."""
    path = F.try_parse_url(url, F.lit("PATH"))
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    last = F.substring_index(F.regexp_replace(decoded, "/+$", ""), "/", -1)
    return F.coalesce(blank_to_null(last), F.concat(identifier, F.lit(".csv.gz")))


def _first_match(text: Column, patterns: Iterable[str], group: int) -> Column:
    return F.coalesce(*[blank_to_null(F.regexp_extract(text, p, group)) for p in patterns])


def is_archive_resource(resources: DataFrame) -> Column:
    """Downloadable hourly archives, without documentation."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    url = F.lower(F.coalesce("url", F.lit("")))
    form = F.lower(F.coalesce("format", F.lit("")))
    return (kind != "documentation") & (url.endswith(".csv.gz") | form.isin("csv.gz", "gz"))


def parse_resources(raw: DataFrame) -> DataFrame:
    """Catalog records as file name, department and period.

    Patterns are slow, so records are spread over tasks first.  Names and what is found in them are generated rows:
    a later filter or projection reads them and does not search the texts again.
    """
    spread = raw.where(is_archive_resource(raw)).repartition("id")
    named = spread.select("*", F.explode(F.array(file_name(F.col("url"), F.col("id")))).alias("filename"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "filename")
    texts = named.select("*", F.explode(F.array(text)).alias("text"))
    found = F.struct(
        F.upper(_first_match(F.col("text"), DEPARTMENT_PATTERNS, 1)).alias("department"),
        _first_match(F.col("text"), PERIOD_PATTERNS, 0).alias("period"),
    )
    # Both years from one match: four digits at its end, and the four before the signs between them.
    period = F.col("found.period")
    return texts.select("*", F.explode(F.array(found)).alias("found")).select(
        F.col("id").alias("resource_id"),
        "title",
        "url",
        "format",
        "last_modified",
        F.col("filesize").alias("expected_size"),
        "filename",
        F.col("found.department").alias("department"),
        F.regexp_extract(period, r"(\d{4})[_\s-]+\d{4}$", 1).cast("int").alias("period_start"),
        F.right(period, F.lit(4)).cast("int").alias("period_end"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A saved catalog document as raw resource records."""
    document = spark.read.schema(CATALOG).option("multiLine", True).json(path)
    return document.select(F.inline("resources"))


def select_resources(
    resources: DataFrame, departments: Iterable[str] | None = None,
    start_year: int | None = None, end_year: int | None = None,
) -> DataFrame:
    """Resources of some departments and years, in catalog order.

    They are stored before they are sorted: a sort looks at its input twice.
    """
    chosen = resources
    if departments:
        chosen = chosen.where(F.col("department").isin(sorted({d.upper() for d in departments})))
    if start_year is not None or end_year is not None:
        chosen = chosen.where(
            periods_overlap(F.col("period_start"), F.col("period_end"), start_year, end_year)
        )
    zero, blank = F.lit(0), F.lit("")
    return stored(chosen, "resources").orderBy(
        F.coalesce("department", blank),
        F.coalesce("period_start", zero),
        F.coalesce("period_end", zero),
        F.coalesce("title", blank),
    )

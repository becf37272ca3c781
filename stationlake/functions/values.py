"""Scalar rules for source values, names, labels and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationlake.schema import (
    DEPARTMENT_NAMES,
    DOUBTFUL,
    SPARK_TYPES,
    UNSIGNED_LIMITS,
    source_type,
)

# Name patterns of the source archives and dictionary units.
ARCHIVE_NAME = (
    r"^H_(2A|2B|[0-9]{2,3})_(?:(?:latest|previous)-)?([0-9]{4})-([0-9]{4})\.csv\.gz$"
)
UNIT_IN_DESCRIPTION = r"(?i)\(en ([^)]+)\)"


# A type letter after a digit or point, or hexadecimal notation.
NOT_DECIMAL = r"(?i)[0-9.][df]\s*$|0x"


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def parse_number(value: Column) -> Column:
    """Decimal text as a double; NULL when it is no number.

    The engine's cast also takes a type letter at the end (``12d``) and hexadecimal digits; those are no
    decimal numbers here, while ``nan`` and ``inf`` are read as such.  Nearly all numbers end with a digit
    and hold no ``x``; only the others meet the pattern.  Names and other words are told by their first letter, as a
    cast that fails costs as much as many that do not.
    """
    first = F.substring(value, 1, 1)
    plausible = (first <= "9") | first.isin("n", "N", "i", "I")
    odd = ~F.substring(value, -1, 1).between("0", "9") | value.contains("x") | value.contains("X")
    return F.when(plausible & ~(odd & value.rlike(NOT_DECIMAL)), value.try_cast("double"))


def convert_metric(value: Column, column: str) -> Column:
    """Typed metric value: blank is NULL, whole-number metrics drop the fraction.

    Kept small on purpose: a fact row has nearly two hundred of these.
    """
    kind = source_type(column)
    number = parse_number(value)
    if kind == "float":
        return number.cast(SPARK_TYPES[kind])
    whole = number.try_cast("int")
    return F.when(whole.between(0, UNSIGNED_LIMITS[kind]), whole).cast(SPARK_TYPES[kind])


def is_bad_metric(value: Column, column: str) -> Column:
    """A populated value that does not convert to the metric's type."""
    return is_populated(value) & convert_metric(value, column).isNull()


def is_populated(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def is_finite_number(value: Column) -> Column:
    """Populated text that parses as a number (used for type inference)."""
    return parse_number(value).isNotNull()


def not_doubtful(quality: Column) -> Column:
    """Keeps rows without a code and every code but 2 (doubtful)."""
    return quality.isNull() | (quality != DOUBTFUL)


def capped_percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, at most 100; 0 for an empty whole."""
    return F.least(F.lit(100.0), percentage(part, whole))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def archive_department(name: Column) -> Column:
    """Department code in an archive name; NULL when the name is no archive."""
    return blank_to_null(F.regexp_extract(name, ARCHIVE_NAME, 1))


def archive_start(name: Column) -> Column:
    return blank_to_null(F.regexp_extract(name, ARCHIVE_NAME, 2)).cast("int")


def archive_end(name: Column) -> Column:
    return blank_to_null(F.regexp_extract(name, ARCHIVE_NAME, 3)).cast("int")


def is_metropolitan(code: Column) -> Column:
    digits = code.rlike("^[0-9]+$")
    number = F.when(digits, code).cast("bigint")
    return code.isin("2A", "2B") | (digits & number.between(1, 95))


def department_name(code: Column) -> Column:
    """Name of a department, or a name built from its code."""
    pairs = [F.lit(text) for item in DEPARTMENT_NAMES.items() for text in item]
    return F.coalesce(F.create_map(*pairs)[code], F.concat(F.lit("Département "), code))


def official_unit(description: Column) -> Column:
    """Unit text after "(en ...)" in a dictionary description."""
    return F.when(
        description.rlike(UNIT_IN_DESCRIPTION),
        F.trim(F.regexp_extract(description, UNIT_IN_DESCRIPTION, 1)),
    )


def title_words(name: Column) -> Column:
    """Underscores to blanks and every run of letters capitalised (UV2X -> Uv2X)."""
    runs = F.regexp_extract_all(name, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda run: F.initcap(F.replace(run, F.lit("_"), F.lit(" ")))), ""
    )


def schema_fingerprint(columns: Column) -> Column:
    """Order-sensitive 12-hex digest of a column list."""
    joined = F.array_join(columns, "\x1f")
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 12)


def unknown_code_columns(columns: Column, known) -> Column:
    """Quality-like columns (Q...) that the fixed schema does not hold, sorted."""
    quality = F.filter(columns, lambda c: c.startswith("Q"))
    return F.array_sort(F.array_except(quality, F.array(*[F.lit(c) for c in sorted(known)])))


def json_set(values: Column) -> Column:
    """Distinct values of an array, sorted, as JSON text."""
    return F.to_json(F.array_sort(F.array_distinct(values)))

"""The official column dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.sources.files import exists


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """``NAME : description`` lines (columns ``line_number``, ``line``) as name, description.

    Text after the first colon is the description; names with a blank are prose;
    the last line of a name wins.
    """
    parts = F.split("line", ":", 2)
    entries = lines.where(F.col("line").contains(":")).select(
        F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("description"), "line_number"
    )
    named = entries.where((F.col("name") != "") & ~F.col("name").contains(" "))
    return named.groupBy("name").agg(F.max_by("description", "line_number").alias("description"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary file as name, description; empty where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "name string, description string")
    text = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "^﻿", ""), r"\r\n|\n|\r")
    return parse_dictionary(text.select(F.posexplode(lines).alias("line_number", "line")))

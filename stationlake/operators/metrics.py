"""The metric dimension: labels, units and types of every fixed column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions import values
from stationlake.schema import (
    DATASET_VERSION,
    DICTIONARY_SOURCE,
    METRIC_LABELS,
    TABLE_METRICS,
    is_code,
    source_type,
    table_columns,
)


def metric_label(name, labels):
    """English label of a metric, or its name in title case; ``labels`` is a map column."""
    return F.coalesce(labels[name], values.title_words(name))


def label_map():
    return F.create_map(*[F.lit(text) for item in METRIC_LABELS.items() for text in item])


def describe_columns(columns: DataFrame) -> DataFrame:
    """Labels and roles of columns given as ``source_mnemonic`` and ``physical_type``.

    A quality column names its base metric: with the base's curated label, else
    with the bare name.
    """
    name = F.col("source_mnemonic")
    labels = label_map()
    quality_for = F.when(name.startswith("Q"), F.substring(name, 2, 1_000))
    quality_label = F.concat(F.lit("Quality code for "), F.coalesce(labels[quality_for], quality_for))
    label = F.when(quality_for.isNotNull(), quality_label).otherwise(metric_label(name, labels))
    described = columns.withColumns({"quality_for": quality_for, "english_label": label})
    return described.withColumns(
        {
            "english_description": F.when(
                F.col("quality_for").isNotNull(),
                F.concat(
                    F.lit("Météo-France quality code associated with "), "quality_for", F.lit(".")
                ),
            ).otherwise(F.concat(F.lit("Météo-France hourly measurement: "), "english_label", F.lit("."))),
            "categorical": F.col("physical_type") != "float",
        }
    )


def metric_dimension(spark: SparkSession, dictionary: DataFrame) -> DataFrame:
    """One row per metric, quality and status column of the fact tables."""
    fixed = []
    for table in TABLE_METRICS:
        names = table_columns(table)
        for name in names:
            partner = "Q" + name if not is_code(name) and "Q" + name in names else None
            fixed.append((name, partner, table.removeprefix("hourly_"), table, source_type(name)))
    columns = spark.createDataFrame(
        fixed,
        "source_mnemonic string, quality_mnemonic string, category string, owning_table string, "
        "physical_type string",
    )
    joined = attach_official_text(describe_columns(columns), dictionary)
    return joined.select(
        "source_mnemonic", "quality_mnemonic", "quality_for", "category", "owning_table",
        "physical_type", "official_description_fr", "official_unit_text", "english_label",
        "english_description", F.lit(True).alias("english_text_curated"), "categorical",
        F.lit(DICTIONARY_SOURCE).alias("documentation_source"),
        F.lit(DATASET_VERSION).alias("schema_version"),
    )


def attach_official_text(metrics: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Official description and the unit it states, by metric name."""
    official = dictionary.select(
        F.col("name").alias("source_mnemonic"), F.col("description").alias("official_description_fr")
    )
    return metrics.join(official, "source_mnemonic", "left").withColumn(
        "official_unit_text", values.official_unit(F.col("official_description_fr"))
    )

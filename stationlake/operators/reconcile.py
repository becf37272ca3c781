"""Catalog resources against local files and server sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("complete", "missing", "partial", "invalid", "unknown-size")
NO_LENGTH = "HEAD response did not include a usable Content-Length"


def file_status(local: Column, partial: Column, catalog: Column, server: Column) -> Column:
    """State of a local file; a server size wins over the catalog size."""
    return (
        F.when(local.isNull(), F.when(partial.isNotNull(), "partial").otherwise("missing"))
        .when(catalog.isNull(), "unknown-size")
        .when(local == catalog, "complete")
        .when(local == server, "complete")
        .otherwise("invalid")
    )


def reconcile_files(
    resources: DataFrame, local_files: DataFrame, partial_files: DataFrame, server_sizes: DataFrame
) -> DataFrame:
    """Resources with local size, partial size, server size and their state.

    ``local_files`` and ``partial_files`` have filename and size (partial names
    without their suffix), ``server_sizes`` filename, server_size, remote_error.
    The server is only consulted where local and catalog size differ.
    """
    joined = (
        resources.join(local_files.select("filename", F.col("size").alias("local_size")), "filename", "left")
        .join(partial_files.select("filename", F.col("size").alias("partial_size")), "filename", "left")
        .join(
            server_sizes.select("filename", F.col("server_size").alias("reported"), "remote_error"),
            "filename",
            "left",
        )
    )
    local, partial, catalog = F.col("local_size"), F.col("partial_size"), F.col("expected_size")
    differs = local.isNotNull() & catalog.isNotNull() & (local != catalog)
    asked = F.when(differs, F.col("reported"))
    status = file_status(local, partial, catalog, asked)
    source = (
        F.when(local.isNull() | catalog.isNull(), "unavailable")
        .when(~differs | asked.isNull(), "catalog")
        .otherwise("server")
    )
    mismatch = F.coalesce(differs, F.lit(False)) & (asked.isNull() | (asked != catalog))
    error = F.when(differs & asked.isNull(), F.coalesce("remote_error", F.lit(NO_LENGTH)))
    redundant = status.isin("complete", "unknown-size") & F.coalesce(partial == local, F.lit(False))
    return joined.withColumns(
        {
            "status": status,
            "server_size": asked,
            "size_source": source,
            "catalog_mismatch": mismatch,
            "remote_error": error,
            "redundant_partial": redundant,
        }
    ).drop("reported")


def archive_status_summary(reconciled: DataFrame) -> DataFrame:
    """One row: files per state, known size, discrepancies, redundant partials."""
    status = F.col("status")
    return reconciled.agg(
        F.count("*").alias("selected_resources"),
        F.coalesce(F.sum("expected_size"), F.lit(0)).alias("known_expected_size"),
        *[F.count_if(status == name).alias(name.replace("-", "_")) for name in STATUSES],
        F.count_if("catalog_mismatch").alias("size_discrepancies"),
        F.count_if("redundant_partial").alias("redundant_partials"),
    )

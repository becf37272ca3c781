"""Writing report tables and CSV exports."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.operators.selection import Selection


def write_report(rows: DataFrame, folder: str, name: str, provenance: dict) -> str:
    """A report as Parquet, with its provenance in the metadata of the first column."""
    path = f"{folder.rstrip('/')}/{name}"
    first, *rest = rows.columns
    details = {"provenance": json.dumps(provenance, sort_keys=True, default=str)}
    described = rows.select(F.col(first).alias(first, metadata=details), *rest)
    described.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def report_provenance(mode: str, source: str, selected: int, filters: dict) -> dict:
    return {
        "generated_at": dt.datetime.now(dt.timezone.utc).isoformat(),
        "mode": mode,
        "source_archive_path": source,
        "selected_archives": selected,
        "filters": filters,
    }


def export_name(selection: Selection, kind: str) -> str:
    place = selection.department or "all"
    return (
        f"meteo_france_{place}_{selection.metric}_{selection.start.isoformat()}_"
        f"{selection.end.isoformat()}_{kind}.csv"
    )


def export_csv(result: DataFrame, folder: str, selection: Selection, kind: str) -> str:
    """A result as CSV with headers, in a folder named like the file, one part per writing task."""
    path = f"{folder.rstrip('/')}/{export_name(selection, kind)}"
    result.write.mode("overwrite").option("header", True).csv(path)
    return path

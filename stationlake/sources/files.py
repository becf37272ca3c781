"""File access shared by sources and sinks: listings, streams in tasks, deletes."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str, recursive: bool = False) -> DataFrame:
    """Files under a folder: path, name, size, modification time.

    The content column is pruned, so no file is read.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )
    return listing.select(
        "path",
        F.substring_index("path", "/", -1).alias("filename"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
    )


def _arrow_location(path: str):
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    if "://" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def open_stream(path: str, compression: str | None = None):
    """A byte stream on any file system Arrow can reach (used inside tasks)."""
    system, location = _arrow_location(path)
    with system.open_input_stream(location, compression=compression) as stream:
        yield stream


@contextmanager
def create_stream(path: str):
    """A new file to write bytes to, with its folder (used inside tasks)."""
    system, location = _arrow_location(path)
    system.create_dir(location.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(location, compression=None) as stream:
        yield stream


def _hadoop_path(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    system, location = _hadoop_path(spark, path)
    return bool(system.exists(location))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder or file of a dataset on its own file system."""
    system, location = _hadoop_path(spark, path)
    system.delete(location, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    system, location = _hadoop_path(spark, source)
    goal = _hadoop_path(spark, target)[1]
    system.mkdirs(goal.getParent())
    if not system.rename(location, goal):
        raise OSError(f"Cannot move {source} to {target}")


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path."""
    system, location = _hadoop_path(spark, path)
    if not system.exists(location):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(location) if s.isDirectory())


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a table folder holds any data (dot and underscore files are not data)."""
    system, location = _hadoop_path(spark, path)
    if not system.exists(location):
        return False
    return any(
        not s.getPath().getName().startswith(("_", ".")) for s in system.listStatus(location)
    )

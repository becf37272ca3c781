"""Spark session settings the library depends on."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job needs for right results.  They are runtime settings, so a
# session that a cluster handed us can be brought in line after it was built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Department codes such as '01' must stay text when read from directory names.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Some archives are windows-1252; Spark 4 refuses that charset otherwise.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Only a new session can take these.  Recording call sites makes it several times
# slower to build the wide fact projections.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Runtime settings for one write; underscores in names stand for dots."""
    names = {key: "spark.sql." + key.replace("_", ".") for key in values}
    before = {name: spark.conf.get(name, None) for name in names.values()}
    try:
        for key, name in names.items():
            spark.conf.set(name, values[key])
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def local_session(name: str = "stationlake", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in (START_CONF | RUNTIME_CONF).items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables that every executor can reach.

    Clusters name the shared location in ``spark.checkpoint.dir``.  Only where
    nothing is named (tests, one machine) is a folder under /tmp used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder shared by all executors")
        root = "/tmp/spark-stationlake"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4()}"


def stored(frame: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """The frame written once to the shared folder (or a given one) and read back.

    For a small result that a plan uses several times: its source is read once,
    and a lost executor does not restart the computation behind it.
    """
    spark = frame.sparkSession
    path = f"{folder}/{purpose}" if folder else shared_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)

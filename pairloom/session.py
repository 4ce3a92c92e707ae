"""Session settings, and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# What the jobs in this package want from a session. A cluster's own settings for
# memory, cores and spark.sql.shuffle.partitions stay with whoever runs it.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splitting a write by outcome keeps one open file per outcome and needs no sort.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    # Wide rows (texts, vectors): bound an Arrow batch by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.session.timeZone": "UTC",
}

_shipped: set[str] = set()


def local_session(cores: str = "8", shuffle_partitions: str = "8", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
    )
    for key, value in {**RECOMMENDED_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan of a few unsplittable files as many tasks as there are cores.

    A multi-line CSV or a Parquet file of one row group is read by one task, which would do
    all the work on its rows as well. A scan with enough tasks is left alone, so a large table
    is never shuffled for this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once per application.

    Does the job of ``spark-submit --py-files`` for sessions started without it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package_dir = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package_dir):  # not when already running from a shipped archive
        archive = os.path.join(tempfile.mkdtemp(prefix="pairloom-ship-"), "pairloom.zip")
        with zipfile.ZipFile(archive, "w") as bundle:
            for folder, _, names in os.walk(package_dir):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        bundle.write(full, os.path.relpath(full, os.path.dirname(package_dir)))
        context.addPyFile(archive)
    _shipped.add(context.applicationId)

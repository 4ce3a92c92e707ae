"""Written tables that cut lineage, kept in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="pairloom-scratch-")
    return _local_root


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the scratch root, remembered for ``drop_scratch``."""
    app = spark.sparkContext.applicationId
    path = f"{scratch_root(spark)}/pairloom-{app}/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


def write_scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written.

    Unlike a cached or locally checkpointed frame, the result survives lost executors, and
    later passes read only the columns they need.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process wrote for this application; returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        target = hadoop_path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)

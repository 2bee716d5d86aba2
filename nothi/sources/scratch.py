"""A folder for intermediate tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; below a temporary folder only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="nothi-"))
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/nothi-{uuid.uuid4().hex}")
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return f"{parent}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once and read back, so that no later stage makes it again."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)

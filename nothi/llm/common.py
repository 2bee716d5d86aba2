"""Shared helpers: a scratch area that every executor can reach, and table reading."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="nothi-")
    return _SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the JVM removes it when the application ends."""
    path = f"{shared_root(spark)}/nothi-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return path


#: What Python workers get of whole texts at once.
BATCH_BYTES, _BATCH = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """For tables that an operator returns unwritten: the session's limit, unless it is set lower or by the caller."""
    if spark.conf.get(_BATCH) in ("64MB", "67108864b", str(64 << 20)):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder, by small batches, and read back: cuts lineage and outlives lost executors."""
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_BATCH)
    try:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
        df.write.parquet(path)
    finally:
        conf.set(_BATCH, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote; only for tables that nothing reads any more."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_memory() -> None:
    """Gives back what a Python worker holds but does not use: workers live on from stage to stage, beside those of the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What workers keep from task to task, by kind of work.
WORKER_CACHES: dict[str, dict] = {}


def keep_only(kind: str | None) -> None:
    """A worker that turns to other work forgets what it kept for the work before."""
    for k, cache in WORKER_CACHES.items():
        if k != kind:
            cache.clear()


def freeing(batches, kind: str | None = None):
    """The batches; after each, memory is given back."""
    keep_only(kind)
    for b in batches:
        yield b
        del b
        free_memory()


def open_fs(uri: str):
    """(filesystem, path) for a URI, for file access from Python workers."""
    import pyarrow.fs as pafs

    # Hadoop's names of one store.
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def create(uri: str):
    """A binary stream to a new file, with the folders above it."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; extra columns of the input never reach an operator's own."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def utf8(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def crc32_u32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

"""Intermediate tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names the folder.  Where the session has none, a
temporary one is made if the master is local (tests, a laptop); on a cluster
that would be a folder of the driver alone, so there it is an error.  Tables
written here cut lineage: a lost executor costs a re-read, never a
recomputation of the whole plan.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []
_own: dict[str, str] = {}  # by application, where the session names no folder


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get(_KEY, "") or spark.sparkContext.getConf().get(_KEY, "")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="quarry-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A folder name in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextlib.contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends; the setting is the session's own again afterwards."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return what was written."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    with _clean_shuffles(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._quarry_path = path
    return written


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made here, which nothing may read any more."""
    drop(spark, df._quarry_path)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def release(spark: SparkSession | None = None) -> None:
    """Delete every intermediate table of this process; results that read them must be written first."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        for path in list(_made):
            drop(spark, path)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone; the shared folder is the cluster's to clean then
        release()


atexit.register(_at_exit)


def unused(df: DataFrame, prefix: str) -> str:
    """The prefix, with so many underscores in front that no column of df begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def cut(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, so that what is made of long texts fits a worker's memory; at their end the worker gives back what it holds."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)
    give_back()


def give_back() -> None:
    """Free memory of this worker goes back to the system, where other processes of the executor can have it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)

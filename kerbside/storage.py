"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_open_paths: ContextVar[list[str] | None] = ContextVar("open_paths", default=None)
on_removal: list[Callable[[], None]] = []  # what else knows of the tables
_local_folder: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local run without one gets its own."""
    global _local_folder
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="kerbside-")
    return _local_folder.name


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kerbside/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: later passes neither recompute it nor depend
    on the executors that produced it, and the planner sees its real size."""
    path = new_path(df.sparkSession, name)
    open_paths = _open_paths.get()
    if open_paths is not None:
        open_paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the session's file system (a classic driver is needed)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, when their results are stored elsewhere."""
    paths: list[str] = []
    token = _open_paths.set(paths)
    try:
        yield
    finally:
        _open_paths.reset(token)
        for path in paths:
            remove_path(spark, path)


def remove_tables(spark: SparkSession) -> None:
    """Remove every intermediate table of this application, for use at its end."""
    remove_path(spark, _application_folder(spark))
    for forget in on_removal:
        forget()


#: Up to so many files are looked at one by one; more are listed by a job.
LISTED_FILES = 1_000


def _statuses(spark: SparkSession, path: str) -> list[tuple] | None:
    """Path, time and length of the files below a path, None if there are many."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    status = files.getFileStatus(target)
    if status.isFile():
        return [(path, status.getModificationTime(), status.getLen())]
    if files.getContentSummary(target).getFileCount() > LISTED_FILES:
        return None
    found, below = [], files.listFiles(target, True)
    while below.hasNext():
        status = below.next()
        found.append((status.getPath().toString(), status.getModificationTime(), status.getLen()))
    return sorted(found)


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """Changes whenever a file below the paths changes; only the file listing is read."""
    statuses = [_statuses(spark, path) for path in paths]
    if all(own is not None for own in statuses):
        return tuple(file for own in statuses for file in own)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(list(paths))
        .select("path", "modificationTime", "length")
    )
    return tuple(
        files.agg(
            F.count(F.lit(1)),
            F.sum("length"),
            F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")),
        ).first()
    )

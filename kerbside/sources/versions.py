"""Versions of a folder of tables: a build writes a new one, and readers follow the last one published.

A version is a folder of its own, and it counts only when its mark exists: an empty file of the same name
in ``published``, made in one step after all tables are written. A build that fails leaves no mark, and a
reader that opened a version keeps it until ``prune`` removes it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

from kerbside.storage import remove_path

_MARKS = "published"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    target, files = _files(spark, path)
    if not files.exists(target):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(target))


def new_version(folder: str) -> str:
    """Path of a version to be written; later ones sort behind earlier ones."""
    return f"{folder.rstrip('/')}/version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def publish(spark: SparkSession, version: str) -> None:
    folder, name = version.rsplit("/", 1)
    mark, files = _files(spark, f"{folder}/{_MARKS}/{name}")
    files.create(mark, False).close()


def published(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all published versions, the last one last."""
    root = folder.rstrip("/")
    return [f"{root}/{name}" for name in _listed(spark, f"{root}/{_MARKS}") if name.startswith("version-")]


def current(spark: SparkSession, folder: str) -> str:
    """The last published version; the folder itself if it holds tables without versions."""
    found = published(spark, folder)
    return found[-1] if found else folder


def prune(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove all published versions but the last ``keep``, mark first, and return their paths. Versions that were
    never published may still be written and are left alone."""
    old = published(spark, folder)[: -max(keep, 1)]
    for version in old:
        root, name = version.rsplit("/", 1)
        remove_path(spark, f"{root}/{_MARKS}/{name}")
        remove_path(spark, version)
    return old

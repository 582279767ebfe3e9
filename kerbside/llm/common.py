"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.storage import new_path, remove_path


#: A written table of known size has about so many rows a file.
FILE_ROWS = 4_096


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this library where the driver does. That is enough where they share the
    driver's disk; on a cluster the library is installed or shipped with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids count as the text ``null``."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    return F.crc32(text.cast("binary")) % divisor


class Steps:
    """Written intermediate tables of one operator, in the folder that all executors share.

    ``keep`` writes a table and reads it back, so later passes neither recompute it nor depend
    on the executors that made it. ``drop`` removes tables that no later step reads and lets
    Spark clean the shuffle files of finished steps.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[str, str] = {}

    def keep(
        self, df: DataFrame, name: str, rows: int | None = None, compression: str | None = None
    ) -> DataFrame:
        """With ``rows``, about how many there are, a small table gets few files instead of one per
        shuffle partition; every file costs its tasks, its commit and its footer. ``compression`` is
        that of the files, the session's own without it."""
        path = new_path(self.spark, name)
        if rows is not None:
            most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            files = -(-rows // FILE_ROWS)
            if files < most:
                df = df.coalesce(max(1, files))
        df.write.parquet(path, compression=compression)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove_path(self.spark, self._paths.pop(name))
        self.clean()

    def clean(self) -> None:
        """Spark drops shuffle files once their plans are garbage on the driver."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column without nulls (null reads as empty)."""
    return pc.fill_null(batch.column(name), "")


def text_slices(
    batch: pa.RecordBatch, name: str = "text", limit: int = 1 << 20
) -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch in runs of about ``limit`` bytes: (first row, texts)."""
    column = text_column(batch, name)
    lengths = pc.binary_length(column).to_pylist()
    first, held = 0, 0
    for row, length in enumerate(lengths):
        if held and held + length > limit:
            yield first, column.slice(first, row - first).to_pylist()
            first, held = row, 0
        held += length
    if first < len(lengths):
        yield first, column.slice(first).to_pylist()

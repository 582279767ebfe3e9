"""Curated Parquet tables: one folder holding codes, signs, spots and spot_periods, and an index of the files
of signs and spots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.functions.grid import Grid
from kerbside.operators.viewport import BBox
from kerbside.sources.slices import INDEX, SlicedTable, index_rows
from kerbside.sources.versions import current

_SCHEMAS = {
    "codes": schemas.CODE_TABLE,
    "signs": schemas.SIGNS,
    "spots": schemas.SPOTS,
    "spot_periods": schemas.SPOT_PERIODS,
}
_INDEXED = ("signs", "spots")

# Rows of one slice are neighbours; each has its own folder, so files never mix distant ones.
SLICE = "slice"

# A viewport meets few rows of a large row group: the scan skips whole pages by their bounds.
_PAGES = {"parquet.page.row.count.limit": "1000", "parquet.block.size": str(32 * 1024 * 1024)}


def table_path(folder: str, table: str) -> str:
    return f"{folder.rstrip('/')}/{table}.parquet"


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    schema = _SCHEMAS[table]
    return spark.read.schema(schema).parquet(table_path(folder, table)).select(*schema.names)


def write_table(df: DataFrame, folder: str, table: str) -> None:
    """Overwrite one curated table, in the declared column order, sliced if it has slices."""
    names = _SCHEMAS[table].names
    path = table_path(folder, table)
    if SLICE in df.columns:
        rows = df.select(*names, SLICE).sortWithinPartitions(SLICE, names[0])
        rows.write.mode("overwrite").options(**_PAGES).partitionBy(SLICE).parquet(path)
    else:
        df.select(*names).write.mode("overwrite").options(**_PAGES).parquet(path)


def write_index(spark: SparkSession, folder: str, table: str, grid: Grid) -> None:
    """The index of the files of a written table, whose rows were sorted by the tiles of ``grid``."""
    path = table_path(folder, table)
    rows = index_rows(spark.read.schema(_SCHEMAS[table]).parquet(path), path.rsplit("/", 1)[1], grid)
    rows.coalesce(1).write.mode("overwrite").parquet(table_path(folder, f"{table}_index"))


def _slices(spark: SparkSession, folder: str, table: str, rows: DataFrame) -> SlicedTable:
    index = spark.read.schema(INDEX).parquet(table_path(folder, f"{table}_index"))
    return SlicedTable.load(rows, table_path(folder, table), index)


@dataclass(frozen=True)
class Curated:
    codes: DataFrame
    signs: DataFrame
    spots: DataFrame
    spot_periods: DataFrame
    sign_slices: SlicedTable | None = None
    spot_slices: SlicedTable | None = None
    split_spots: bool = True

    def signs_near(self, bbox: BBox) -> DataFrame:
        """Signs from the files that a box can meet; all of them where there is no index."""
        return self.signs if self.sign_slices is None else self.sign_slices.within(bbox)

    def spots_near(self, bbox: BBox) -> DataFrame:
        if self.spot_slices is None:
            return self.spots
        return _parted(self.spot_slices.within(bbox), self.split_spots)


def _parted(spots: DataFrame, split: bool) -> DataFrame:
    """Without any split spot the number of parts is a constant, and the planner drops the branches
    that would combine parts from every spot query."""
    return spots if split else spots.withColumn("n_parts", F.lit(1).cast("bigint"))


def load(spark: SparkSession, folder: str) -> Curated:
    """The four tables of the last published version, and the indexes of signs and spots (a row per file, kept on the driver).

    One look at the spots tells whether any spans several rows, which row-group statistics
    answer.
    """
    folder = current(spark, folder)
    tables = {table: read_table(spark, folder, table) for table in _SCHEMAS}
    split = not tables["spots"].where(F.col("n_parts") > 1).isEmpty()
    slices = {table: _slices(spark, folder, table, tables[table]) for table in _INDEXED}
    tables["spots"] = _parted(tables["spots"], split)
    return Curated(
        **tables, sign_slices=slices["signs"], spot_slices=slices["spots"], split_spots=split
    )

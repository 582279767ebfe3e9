"""Which files of a table in Z-order a box can meet.

A curated table of points is range-sorted by tile, so each of its files holds one stretch of the Z-order.
The index has a row per file: its first and last code, the extent of its points and its number of rows. A
box meets a file only if some code of the box lies in the file's stretch, which ``next_in_box`` answers for
all files at once, and if the extents meet. The box of a stretch alone would not do: a stretch that crosses
a coarse tile edge has an extent far wider than its points.

The index lives on the driver as arrays: some 100 bytes a file, and files are as many as the tasks that
wrote the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions.grid import Grid
from kerbside.functions.zorder import interleaved, next_in_box
from kerbside.operators.viewport import BBox

INDEX = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("first_cell", T.LongType()),
        T.StructField("last_cell", T.LongType()),
        T.StructField("west", T.DoubleType()),
        T.StructField("south", T.DoubleType()),
        T.StructField("east", T.DoubleType()),
        T.StructField("north", T.DoubleType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("grid_bounds", T.ArrayType(T.DoubleType())),
        T.StructField("grid_level", T.IntegerType()),
    ]
)


def index_rows(table: DataFrame, folder: str, grid: Grid) -> DataFrame:
    """One row per file of a table that was read from a folder of that name and has longitude and latitude; files
    are named from the folder on, so the tables may be moved."""
    cell = grid.cell(F.col("longitude"), F.col("latitude"))
    file = F.substring_index("_metadata.file_path", f"/{folder}/", -1)
    return (
        table.select(file.alias("file"), cell.alias("cell"), "longitude", "latitude")
        .groupBy("file")
        .agg(
            F.min("cell").alias("first_cell"),
            F.max("cell").alias("last_cell"),
            F.min("longitude").alias("west"),
            F.min("latitude").alias("south"),
            F.max("longitude").alias("east"),
            F.max("latitude").alias("north"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .select(
            "*",
            F.array(*[F.lit(float(b)) for b in grid.bounds]).alias("grid_bounds"),
            F.lit(grid.max_level).alias("grid_level"),
        )
        .select(*INDEX.names)
    )


@dataclass(frozen=True)
class SlicedTable:
    """A table, and the files of it that a box can meet."""

    table: DataFrame
    files: list[str]
    first: np.ndarray
    last: np.ndarray
    extents: np.ndarray  # files x (west, south, east, north)
    n_rows: np.ndarray
    grid: Grid

    @staticmethod
    def load(table: DataFrame, path: str, index: DataFrame) -> "SlicedTable":
        rows = index.orderBy("first_cell", "file").collect()  # a row per file
        grid = Grid(tuple(rows[0]["grid_bounds"]), max_level=rows[0]["grid_level"]) if rows else Grid()
        return SlicedTable(
            table,
            [f"{path}/{r['file']}" for r in rows],
            np.array([r["first_cell"] for r in rows], np.uint64),
            np.array([r["last_cell"] for r in rows], np.uint64),
            np.array([r[3:7] for r in rows], float).reshape(-1, 4),
            np.array([r["n_rows"] for r in rows], np.int64),
            grid,
        )

    def met_by(self, bbox: BBox) -> np.ndarray:
        """Places of the files that may hold points of the box."""
        west, south, east, north = bbox
        if not (west <= east and south <= north):
            return np.zeros(0, int)
        low, high = self.grid.code(west, south), self.grid.code(east, north)
        reached = next_in_box(self.first, low, high, self.grid.max_level) <= self.last
        # written so that a file with a point that is not a number stays
        apart = (
            (self.extents[:, 0] > east) | (self.extents[:, 2] < west)
            | (self.extents[:, 1] > north) | (self.extents[:, 3] < south)
        )
        return np.flatnonzero(reached & ~apart)

    def within(self, bbox: BBox) -> DataFrame:
        """The table, read from the files that the box can meet only. The box itself is not tested."""
        met = self.met_by(bbox)
        if len(met) == len(self.files):
            return self.table
        spark, schema = self.table.sparkSession, self.table.schema
        if not len(met):
            return self.table.where(F.lit(False))
        return spark.read.schema(schema).parquet(*[self.files[place] for place in met])

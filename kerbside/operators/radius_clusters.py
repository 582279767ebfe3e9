"""Marker clusters within a radius of their centre.

Greedy clustering takes the points in a fixed order; a point that no earlier centre lies within the radius
of becomes a centre, and any other joins the first such centre. Here the order is a seeded hash of the
point's id, so the result depends on neither the layout of the data nor the number of tasks, and it is
found in parallel: the centres are the points of which no point before them within the radius is a centre.

A square of side radius / sqrt(2) holds only points within the radius of each other. So of the undecided
points of a square only the first can be the next centre, and it is one if it comes before the first
undecided points of the 24 squares that the radius reaches. Each round makes all such points centres and
drops the points around them; only the firsts of squares are compared, one row per square, and a point
meets the few centres near it, so a crowded square costs its size and not its pairs.

Levels are built from the finest one up: the centres of a zoom level, with the number of points they stand
for, are the points of the next coarser one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.grid import pixel
from kerbside.operators.clusters import RADIUS, UNCLUSTERED_ZOOM
from kerbside.storage import written

SEED = 17
_SIDE = RADIUS / 2**0.5 - 1e-6
_REACH = 2  # squares, in each direction
_BLOCK = 32  # squares, in each direction
_CELL = 2 * RADIUS + 1  # pixels: the circle around a centre meets at most two by two cells
_PLACE = ["id", "longitude", "latitude"]


def _placed(points: DataFrame, zoom: int, seed: int) -> DataFrame:
    """Adds mark, x and y, which are made anew wherever they are needed: only id and place are kept in tables."""
    x, y = pixel(F.col("longitude"), F.col("latitude"), F.lit(zoom))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    return points.select("*", F.unhex(mark).alias("mark"), x.alias("x"), y.alias("y"))


def _floor(value: Column, width: float) -> Column:
    return F.floor(value / width)


def _touched(x: Column, y: Column, reach: float, width: float) -> Column:
    """The fields of a grid that a box around a place meets; none is narrower than the box."""
    corners = [
        F.struct(_floor(x + dx, width).alias("x"), _floor(y + dy, width).alias("y"))
        for dx in (-reach, reach)
        for dy in (-reach, reach)
    ]
    return F.array_distinct(F.array(*corners))


def _within_radius(a: str, b: str) -> Column:
    across, down = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return across * across + down * down <= float(RADIUS * RADIUS)


def _in_cells(points: DataFrame) -> DataFrame:
    """Points with the cell they are in."""
    return points.withColumn("cell_x", _floor(F.col("x"), _CELL)).withColumn("cell_y", _floor(F.col("y"), _CELL))


def _over_cells(centres: DataFrame) -> DataFrame:
    """Centres once for each cell their circle may meet."""
    cells = F.explode(_touched(F.col("x"), F.col("y"), RADIUS + 1e-3, _CELL))
    return (
        centres.withColumn("_cell", cells)
        .withColumn("cell_x", F.col("_cell.x"))
        .withColumn("cell_y", F.col("_cell.y"))
        .drop("_cell")
    )


def _near(points: str, centres: str) -> Column:
    same_cell = (F.col(f"{points}.cell_x") == F.col(f"{centres}.cell_x")) & (
        F.col(f"{points}.cell_y") == F.col(f"{centres}.cell_y")
    )
    return same_cell & _within_radius(points, centres)


def _least_along(rows: DataFrame, axis: str, other: str) -> DataFrame:
    """The least of a block's squares up to the reach before and behind each, along one axis; ``own`` stays."""
    step = F.explode(F.array(*[F.lit(s).cast("bigint") for s in range(-_REACH, _REACH + 1)]))
    return (
        rows.withColumn("_step", step)
        .groupBy("block_x", "block_y", (F.col(axis) + F.col("_step")).alias(axis), other)
        .agg(F.min("least").alias("least"), F.min(F.when(F.col("_step") == 0, F.col("own"))).alias("own"))
    )


def _next_centres(undecided: DataFrame) -> DataFrame:
    """The firsts of their squares that come before the firsts of all squares they reach.

    Squares are dealt once to blocks, those at an edge to the blocks beside it too, so that the firsts around
    each are compared where they are and no square is shuffled once for each that it reaches.
    """
    firsts = undecided.groupBy(
        _floor(F.col("x"), _SIDE).alias("square_x"), _floor(F.col("y"), _SIDE).alias("square_y")
    ).agg(F.min(F.struct("mark", "id", "x", "y", "longitude", "latitude")).alias("own"))
    x, y = F.col("square_x"), F.col("square_y")
    dealt = (
        firsts.withColumn("_block", F.explode(_touched(x, y, _REACH, _BLOCK)))
        .select("square_x", "square_y", "own", F.col("_block.x").alias("block_x"), F.col("_block.y").alias("block_y"))
        .repartition("block_x", "block_y")
        .withColumn("least", F.col("own"))
    )
    least = _least_along(_least_along(dealt, "square_x", "square_y"), "square_y", "square_x")
    at_home = (_floor(x, _BLOCK) == F.col("block_x")) & (_floor(y, _BLOCK) == F.col("block_y"))
    return least.where(at_home & (F.col("own") == F.col("least"))).select(*[F.col("own")[c].alias(c) for c in _PLACE])


def centres_of(points: DataFrame, zoom: int, seed: int) -> DataFrame:
    """The centres among points (id, longitude, latitude)."""
    undecided, found = points.select(*_PLACE), []
    while not undecided.isEmpty():
        placed = _placed(undecided, zoom, seed)
        centres = written(_next_centres(placed), "centres")
        found.append(centres)
        captured = _over_cells(_placed(centres, zoom, seed))
        left = _in_cells(placed).alias("p").join(captured.alias("c"), _near("p", "c"), "left_anti")
        undecided = written(left.select(*_PLACE), "undecided")
    whole = points.sparkSession.createDataFrame([], points.select(*_PLACE).schema)
    for centres in found:
        whole = whole.unionByName(centres)
    return whole


def _level(points: DataFrame, zoom: int, seed: int) -> DataFrame:
    """id, longitude, latitude, n_points, n_members of the centres of one zoom level."""
    centres = written(centres_of(points, zoom, seed), "centres")
    joined = (
        _in_cells(_placed(points, zoom, seed))
        .alias("p")
        .join(_over_cells(_placed(centres, zoom, seed)).alias("c"), _near("p", "c"))
        .groupBy(F.col("p.id").alias("point"))
        .agg(
            F.min(F.struct("c.mark", "c.id")).alias("centre"),
            F.any_value("p.n_points").alias("n_points"),
        )
        .groupBy(F.col("centre.id").alias("id"))
        .agg(F.sum("n_points").alias("n_points"), F.count(F.lit(1)).alias("n_members"))
    )
    # a row per centre, written so that the planner sees how few they are beside the points
    joined = written(joined, "joined")
    places = points.select(*_PLACE)
    return written(joined.join(places, "id").select(*_PLACE, "n_points", "n_members"), "level")


def radius_clusters(
    points: DataFrame, id_column: str, zooms: Sequence[int], seed: int = SEED
) -> DataFrame:
    """Clusters of points with a unique id, longitude and latitude: zoom, centre_id, longitude, latitude (of the
    centre), n_points (of ``points``) and n_members (centres of the level below, or points).

    Levels from the finest clustered zoom down to the coarsest asked are built one from the other; from zoom 17
    on every point is a centre of its own. Points with a null coordinate belong to no level.
    """
    located = points.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).select(
        F.col(id_column).alias("id"), "longitude", "latitude", F.lit(1).cast("bigint").alias("n_points")
    )
    outputs, level = [], located
    for zoom in sorted(zooms, reverse=True):
        if zoom >= UNCLUSTERED_ZOOM:
            outputs.append((zoom, located.withColumn("n_members", F.lit(1).cast("bigint"))))
    coarsest = min(zooms)
    for zoom in range(UNCLUSTERED_ZOOM - 1, coarsest - 1, -1):
        level = _level(level.select("id", "longitude", "latitude", "n_points"), zoom, seed)
        if zoom in zooms:
            outputs.append((zoom, level))
    result = None
    for zoom, rows in outputs:
        rows = rows.select(
            F.lit(zoom).alias("zoom"), F.col("id").alias("centre_id"), "longitude", "latitude", "n_points", "n_members"
        )
        result = rows if result is None else result.unionByName(rows)
    return result

"""Marker clusters on a pixel grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.grid import pixel

# Clustering radius in pixels, and the zoom level from which it is off.
RADIUS = 50
UNCLUSTERED_ZOOM = 17

_SCALE = 1e7


def cluster_points(points: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """Clusters of ``longitude``/``latitude`` points per zoom level.

    Columns zoom, cell_x, cell_y, n_points, longitude, latitude (the centroid). From zoom 17
    on, every point passes through with null cells. Of curated spots, pass the rows with
    part_no 0. Centroids are summed in fixed point, so
    they do not depend on the order in which partial sums meet.
    """
    points = points.select("longitude", "latitude")
    clustered = [z for z in zooms if z < UNCLUSTERED_ZOOM]
    single = [z for z in zooms if z >= UNCLUSTERED_ZOOM]

    def at(levels):
        return points.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in levels])))

    outputs = []
    if clustered:
        x, y = pixel(F.col("longitude"), F.col("latitude"), F.col("zoom"))
        outputs.append(
            at(clustered)
            .groupBy(
                "zoom",
                F.floor(x / RADIUS).alias("cell_x"),
                F.floor(y / RADIUS).alias("cell_y"),
            )
            .agg(
                F.count(F.lit(1)).alias("n_points"),
                _centre("longitude").alias("longitude"),
                _centre("latitude").alias("latitude"),
            )
        )
    if single:
        no_cell = F.lit(None).cast("bigint")
        outputs.append(
            at(single).select(
                "zoom",
                no_cell.alias("cell_x"),
                no_cell.alias("cell_y"),
                F.lit(1).cast("bigint").alias("n_points"),
                "longitude",
                "latitude",
            )
        )
    result = outputs[0]
    for other in outputs[1:]:
        result = result.unionByName(other)
    return result


def _centre(name: str) -> Column:
    units = F.round(F.col(name) * F.lit(_SCALE)).cast("decimal(12,0)")
    return F.sum(units).cast("double") / F.count(F.lit(1)) / F.lit(_SCALE)

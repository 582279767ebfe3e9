"""Spatial and attribute filters, and the sizes of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BBox = tuple[float, float, float, float]  # min_lon, min_lat, max_lon, max_lat


def in_bbox(bbox: BBox) -> Column:
    """Closed on all four sides; an inverted box holds nothing."""
    min_lon, min_lat, max_lon, max_lat = bbox
    return F.col("longitude").between(min_lon, max_lon) & F.col("latitude").between(
        min_lat, max_lat
    )


def in_categories(categories: Sequence[str]) -> Column:
    return F.col("category").isin(list(categories))


def is_over(rows: DataFrame, limit: int) -> bool:
    """Whether there are more than ``limit`` rows. Tasks are started a few at a time and stop at the first row too
    many, so an answer that will be refused is neither counted nor gathered."""
    return len(rows.select(F.lit(1)).take(limit + 1)) > limit


def result_sizes(signs: DataFrame, spots: DataFrame, limit: int) -> DataFrame:
    """One row: n_signs, n_paid, n_free, total and whether the total is over the given limit.

    ``spots`` is the answer of a spot query, in which part_no 0 stands for the spot.
    """
    kind = F.when(F.col("is_currently_free"), "free").otherwise("paid")
    markers = signs.select(F.lit("sign").alias("kind")).unionAll(
        spots.where(F.col("part_no") == 0).select(kind.alias("kind"))
    )

    def count_of(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    return markers.agg(
        count_of("sign").alias("n_signs"),
        count_of("paid").alias("n_paid"),
        count_of("free").alias("n_free"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("refused", F.col("total") > limit)

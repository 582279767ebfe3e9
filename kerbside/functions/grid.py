"""Nested square tiles over a bounding area, and web-mercator pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.zorder import interleaved

# The city's bounding box (min_lon, min_lat, max_lon, max_lat).
CITY_BOUNDS = (-73.97, 45.41, -73.48, 45.70)


@dataclass(frozen=True)
class Grid:
    """Tiles of ``2**level`` columns and rows over ``bounds``.

    Points outside the bounds belong to the nearest edge tile. Tile numbers never decrease
    with the coordinate, so a point inside a box is always in one of the box's tiles.
    """

    bounds: tuple[float, float, float, float] = CITY_BOUNDS
    min_level: int = 5
    max_level: int = 16

    @staticmethod
    def covering(points: DataFrame, **levels) -> "Grid":
        """A grid over the extent of a table of points, found by one aggregate."""
        extent = points.agg(
            F.min("longitude"), F.min("latitude"), F.max("longitude"), F.max("latitude")
        ).first()
        if extent[0] is None:
            return Grid(**levels)
        west, south, east, north = extent
        return Grid((west, south, max(east, west + 1e-6), max(north, south + 1e-6)), **levels)

    def _index(self, coordinate: Column, low: float, high: float) -> Column:
        tiles = 1 << self.max_level
        scaled = (coordinate - F.lit(low)) / F.lit(high - low) * F.lit(float(tiles))
        return F.least(
            F.greatest(F.floor(scaled), F.lit(0).cast("bigint")),
            F.lit(tiles - 1).cast("bigint"),
        )

    def column(self, longitude: Column) -> Column:
        """Tile column at the finest level; a coarser level is a right shift of it."""
        return self._index(longitude, self.bounds[0], self.bounds[2])

    def row(self, latitude: Column) -> Column:
        return self._index(latitude, self.bounds[1], self.bounds[3])

    def cell(self, longitude: Column, latitude: Column) -> Column:
        """Finest tile as one number, column and row bits interleaved (Z-order)."""
        return _spread_bits(self.column(longitude)).bitwiseOR(
            F.shiftleft(_spread_bits(self.row(latitude)), 1)
        )

    def code(self, longitude: float, latitude: float) -> int:
        """``cell`` of one point, with the same arithmetic."""

        def index(coordinate: float, low: float, high: float) -> int:
            tiles = 1 << self.max_level
            scaled = (coordinate - low) / (high - low) * float(tiles)
            return math.floor(min(max(scaled, 0.0), tiles - 1.0))

        west, south, east, north = self.bounds
        return interleaved(index(longitude, west, east), index(latitude, south, north), self.max_level)

    def level_for(self, width: Column, height: Column) -> Column:
        """Finest level whose tiles are no smaller than the box, so at most 2 x 2 are met."""
        def fit(extent: float, size: Column) -> Column:
            return F.floor(
                F.log2(F.lit(extent) / F.greatest(size, F.lit(extent / (1 << self.max_level))))
            )

        level = F.least(
            fit(self.bounds[2] - self.bounds[0], width),
            fit(self.bounds[3] - self.bounds[1], height),
        )
        return F.least(
            F.greatest(level, F.lit(self.min_level)), F.lit(self.max_level)
        ).cast("int")

    def tile_at(self, level: Column, column: Column, row: Column) -> Column:
        """Key of the tile of ``level`` that holds a finest-level column and row."""
        shift = F.lit(self.max_level) - level

        def coarse(index: Column) -> Column:
            return F.call_function("shiftright", index, shift)

        return tile_key(level, coarse(column), coarse(row))

    def covering_tiles(
        self, level: Column, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column
    ) -> Column:
        """Keys of the tiles of ``level`` that meet a box; the box must not be inverted."""
        shift = F.lit(self.max_level) - level

        def span(low: Column, high: Column) -> Column:
            return F.sequence(
                F.call_function("shiftright", low, shift),
                F.call_function("shiftright", high, shift),
            )

        columns = span(self.column(min_lon), self.column(max_lon))
        rows = span(self.row(min_lat), self.row(max_lat))
        return F.flatten(
            F.transform(columns, lambda x: F.transform(rows, lambda y: tile_key(level, x, y)))
        )


def tile_key(level: Column, column: Column, row: Column) -> Column:
    return F.shiftleft(level.cast("bigint"), 48) + F.shiftleft(column, 24) + row


def _spread_bits(index: Column) -> Column:
    """Move bit i of a number below 2**16 to bit 2i."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        index = index.bitwiseOR(F.shiftleft(index, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return index


def pixel(longitude: Column, latitude: Column, zoom: Column) -> tuple[Column, Column]:
    """Web-mercator pixel position at a zoom level, 256-pixel world at zoom 0."""
    world = F.lit(256.0) * F.pow(F.lit(2.0), zoom)
    x = (longitude + F.lit(180.0)) / F.lit(360.0) * world
    angle = latitude * F.lit(math.pi / 180.0)
    y = (
        F.lit(0.5)
        - F.log(F.tan(F.lit(math.pi / 4.0) + angle / F.lit(2.0))) / F.lit(2.0 * math.pi)
    ) * world
    return x, y

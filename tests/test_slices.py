"""The index of files in Z-order, and viewports that read only theirs."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from kerbside import schemas
from kerbside.functions.grid import Grid
from kerbside.functions.zorder import interleaved, next_in_box
from kerbside.operators.viewport import in_bbox
from kerbside.plans import signs as S
from kerbside.plans import spots as SP
from kerbside.plans.requests import SignQuery, SpotQuery
from kerbside.sources import curated
from kerbside.sources.curated import SLICE, write_index, write_table


def test_next_code_in_a_box_against_all_codes():
    bits = 4
    place = {interleaved(c, r, bits): (c, r) for c in range(16) for r in range(16)}
    assert sorted(place) == list(range(256))
    draw = random.Random(1)
    codes = np.arange(256)
    for _ in range(300):
        c0, c1 = sorted(draw.randrange(16) for _ in range(2))
        r0, r1 = sorted(draw.randrange(16) for _ in range(2))
        inside = sorted(k for k, (c, r) in place.items() if c0 <= c <= c1 and r0 <= r <= r1)
        found = next_in_box(codes, interleaved(c0, r0, bits), interleaved(c1, r1, bits), bits)
        for code in codes:
            expected = next((k for k in inside if k >= code), 2**64 - 1)
            assert int(found[code]) == expected


def test_code_of_a_point_is_the_cell_of_the_column(spark):
    grid = Grid()
    draw = random.Random(2)
    points = [(draw.uniform(-74.2, -73.3), draw.uniform(45.3, 45.8)) for _ in range(200)]
    points += [(-73.97, 45.41), (-73.48, 45.70), (float("inf"), -90.0)]
    frame = spark.createDataFrame(points, "longitude double, latitude double")
    cells = frame.select(grid.cell(frame.longitude, frame.latitude)).collect()
    assert [r[0] for r in cells] == [grid.code(*p) for p in points]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Signs in 30 slices of the Z-order, and spots in as many files."""
    grid, draw = Grid(), random.Random(3)
    rows = [(draw.uniform(-73.95, -73.5), draw.uniform(45.42, 45.69)) for _ in range(3_000)]
    rows.sort(key=lambda p: grid.code(*p))
    signs = [
        (i, lon, lat, None, "0", i % 3, ("permitted", "prohibited", "other")[i % 3], i % 2 == 0, i // 100)
        for i, (lon, lat) in enumerate(rows)
    ]
    folder = str(tmp_path_factory.mktemp("sliced"))
    sliced = T.StructType([*schemas.SIGNS.fields, T.StructField(SLICE, T.IntegerType())])
    write_table(spark.createDataFrame(signs, sliced).repartition(8, SLICE), folder, "signs")
    spots = [(str(i), lon, lat, 1.0, "T", "S", None, 0, 1) for i, (lon, lat) in enumerate(rows)]
    write_table(spark.createDataFrame(spots, schemas.SPOTS).coalesce(1).repartitionByRange(20, "place_id"), folder, "spots")
    codes = [(i, f"C{i}", f"d{i}", "other", False, [], [], [], False, False, None, None) for i in range(3)]
    write_table(spark.createDataFrame(codes, schemas.CODE_TABLE), folder, "codes")
    write_table(spark.createDataFrame([], schemas.SPOT_PERIODS), folder, "spot_periods")
    for table in ("signs", "spots"):
        write_index(spark, folder, table, grid)
    return curated.load(spark, folder)


BOXES = [
    (-73.60, 45.50, -73.59, 45.505), (-73.76, 45.55, -73.69, 45.56), (-73.97, 45.41, -73.48, 45.70),
    (-75.0, 40.0, -74.0, 41.0), (-73.5, 45.6, -73.6, 45.5), (-80.0, 45.5, -70.0, 45.501),
]


@pytest.mark.parametrize("box", BOXES)
def test_only_files_with_points_near_the_box_are_read(tables, box):
    whole = tables.signs.where(in_bbox(box))
    near = tables.signs_near(box)
    assert sorted(near.where(in_bbox(box)).collect()) == sorted(whole.collect())
    read = set(near.inputFiles()) if len(tables.sign_slices.met_by(box)) else set()
    assert len(read) == len(tables.sign_slices.met_by(box))
    spots = tables.spots_near(box)
    assert spots.where(in_bbox(box)).count() == tables.spots.where(in_bbox(box)).count()


def test_files_opened_by_a_small_viewport(tables):
    """A small box meets the slices its points lie in, and hardly any more."""
    slices = tables.sign_slices
    assert len(slices.files) == 30 and slices.n_rows.sum() == 3_000
    draw, opened = random.Random(4), 0
    for _ in range(60):
        west, south = draw.uniform(-73.9, -73.55), draw.uniform(45.45, 45.65)
        box = (west, south, west + 0.02, south + 0.01)
        opened += len(slices.met_by(box))
    assert opened <= 60 * 5 < 60 * len(slices.files)


def test_queries_over_the_index_are_those_over_the_table(tables):
    box = (-73.72, 45.48, -73.62, 45.55)
    asked = SignQuery(box, categories=("permitted", "other"))
    over_index = S.query_signs(tables.signs_near(box), tables.codes, asked)
    assert sorted(over_index.collect()) == sorted(S.query_signs(tables.signs, tables.codes, asked).collect())
    ask = SpotQuery(box, hour=(9, 10), day=(1, 2))
    over_index = SP.query_spots(tables.spots_near(box), ask)
    assert over_index.count() == SP.query_spots(tables.spots, ask).count() > 0

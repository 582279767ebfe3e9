"""Hot keys, long lists and plans that do not rest on broadcasts."""

import os
import random
from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.functions.grid import Grid
from kerbside.operators import tiles
from kerbside.operators.clusters import cluster_points
from kerbside.operators.lists import bounded_lists
from kerbside.operators.numbering import _positions, number_rows
from kerbside.operators.tiles import points_in_boxes
from kerbside.plans import build as B
from kerbside.plans import spots as SP
from kerbside.plans.requests import SpotQuery
from kerbside.sources import curated, geojson
from kerbside.storage import intermediate_tables, written
from tests import fixtures
from tests.model import contained, spans
from tests.test_queries import query_rows


@contextmanager
def settings(spark, **values):
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_copies_of_one_row_split_over_partitions(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("k"),
        F.monotonically_increasing_id().alias("copy"),
    )
    found = number_rows(rows, ["k"], "n", copy_column="copy").collect()
    assert sorted(r["n"] for r in found) == list(range(20_000))
    by_number = sorted(found, key=lambda r: r["n"])
    assert [r["k"] for r in by_number] == sorted(r["k"] for r in found)
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        partition = F.shiftright("_position", 33)
        sizes = [r[1] for r in _positions(rows, ["k", "copy"]).groupBy(partition).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_intermediate_tables_go_when_their_results_are_stored(spark):
    with intermediate_tables(spark):
        table = written(spark.range(3), "short-lived")
        path = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
    kept = written(spark.range(3), "kept")
    assert kept.count() == 3


def test_lists_of_a_hot_key_are_split_and_whole(spark):
    rows = spark.range(9_000).select(
        F.when(F.col("id") < 6_000, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("item"),
    )
    lists = bounded_lists(rows, ["k"], F.col("item"), "items", 100).collect()
    assert sorted(x for r in lists for x in r["items"]) == list(range(9_000))
    hot = [r for r in lists if r["k"] == "hot"]
    assert len(hot) == 60 and max(len(r["items"]) for r in hot) < 200
    assert all(r["n_parts"] == 1 and r["part_no"] == 0 for r in lists if r["k"] != "hot")


def test_feature_collections_of_a_hot_query(spark):
    rows = spark.range(500).select(
        F.lit(7).cast("bigint").alias("query_id"), F.col("id").alias("sign_id"),
        F.lit("other").alias("category"), F.lit(False).alias("is_reserved"),
        F.lit(None).cast("string").alias("arrondissement"), F.lit("x").alias("description"),
        F.lit(1.5).alias("longitude"), F.lit(2.5).alias("latitude"),
    )
    parts = geojson.collections(rows, geojson.sign_feature, "query_id", per_collection=50)
    schema = "struct<features:array<struct<properties:struct<sign_id:bigint>>>>"
    ids = parts.select(F.explode(F.from_json("collection", schema)["features"]).alias("f"))
    assert parts.count() == 10
    assert sorted(r[0] for r in ids.select("f.properties.sign_id").collect()) == list(range(500))


@pytest.fixture(scope="module")
def long_spot(spark, tmp_path_factory):
    """A place with 300 distinct periods next to small ones."""
    rng = random.Random(3)
    rows = []
    for place, n in (("HOT", 300), ("A", 2), ("B", 1)):
        for i in range(n):
            start, end, mask = rng.randrange(24), rng.randrange(24), rng.randrange(128)
            rows.append(
                (place, i, f"{start:02d}:00:00", f"{end:02d}:{i % 60:02d}:00", float(start),
                 end + (i % 60) / 60.0, mask, f"d{i % 40}", 1)
            )
    periods = spark.createDataFrame(rows, schemas.SPOT_PERIODS)
    places = spark.createDataFrame(
        [(p, "-73.63", "45.54", "1", "T", "S") for p in ("HOT", "A", "B", "EMPTY")],
        schemas.RAW_PLACES,
    )
    path = str(tmp_path_factory.mktemp("spots"))
    B.build_spots(places, periods, periods_per_row=10).write.mode("overwrite").parquet(path)
    return rows, spark.read.schema(schemas.SPOTS).parquet(path)


def test_long_list_spans_rows_and_answers_as_one_spot(spark, long_spot):
    rows, spots = long_spot
    assert spots.where("place_id = 'HOT'").select("part_no").distinct().count() > 10
    queries = [((h, h + 1), (d, d)) for h in range(0, 23, 3) for d in (1, 4, 7)]
    batch = SP.query_spots_batch(
        query_rows(spark, [SpotQuery(fixtures.BOX, hour=h, day=d) for h, d in queries]), spots
    ).collect()
    assert len({(r["query_id"], r["place_id"]) for r in batch if r["part_no"] == 0}) == 4 * len(queries)
    for i, (hour, day) in enumerate(queries):
        for place in ("HOT", "A", "B", "EMPTY"):
            paid = any(
                r[0] == place
                and contained(hour, (r[4], r[5]), 24)
                and any(contained(day, s, 7) for s in spans(r[6]))
                for r in rows
            )
            mine = [r for r in batch if r["query_id"] == i and r["place_id"] == place]
            assert {r["is_currently_free"] for r in mine} == {not paid}
            assert sum(r["part_no"] == 0 for r in mine) == 1
            texts = [t for r in mine for t in r["periods"]]
            assert sorted(texts) == sorted({r[7] for r in rows if r[0] == place})
    single = SP.query_spots(spots, SpotQuery(fixtures.BOX, hour=(3, 4), day=(1, 1)))
    assert single.where("part_no = 0").count() == 4


def test_hot_link_rows_fold_before_they_meet(spark):
    links = spark.range(3_000).select(
        F.when(F.col("id") < 2_500, "HOT").otherwise(F.col("id").cast("string")).alias("sNoEmplacement"),
        F.when(F.col("id") % 2 == 0, "R1").otherwise("R2").alias("sCodeAutocollant"),
    )
    period_links = spark.range(2_000).select(
        F.when(F.col("id") < 1_500, "R1").otherwise("R2").alias("sCode"),
        (F.col("id") % 5).cast("string").alias("noPeriode"),
        F.lit("x").alias("sDescription"),
    )
    periods = spark.range(5).select(
        F.col("id").cast("string").alias("nID"),
        F.concat(F.lit("0"), F.col("id"), F.lit(":00:00")).alias("dtHeureDebut"),
        F.lit("20:00:00").alias("dtHeureFin"),
        *[F.lit("1").alias(c) for c in schemas.RAW_PERIODS.names[3:]],
    )
    raw = B.RawTables(None, None, links, period_links, periods, None)
    found = B.build_spot_periods(raw)
    assert found.where("place_id = 'HOT'").count() == 5
    expected = 1_250 * 1_500 + 1_250 * 500 + 250 * 1_500 + 250 * 500
    assert found.agg(F.sum("n_links")).first()[0] == expected


def _random_boxes(spark, n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lon, lat = rng.uniform(-74.1, -73.4), rng.uniform(45.35, 45.75)
        size = rng.choice([0.0, 1e-4, 0.003, 0.05, 0.3, 2.0])
        rows.append((i, lon, lat, lon + size, lat + size * rng.choice([0.1, 1.0])))
    rows.append((n, -73.5, 45.5, -73.6, 45.6))
    return spark.createDataFrame(rows, "query_id long, min_lon double, min_lat double, max_lon double, max_lat double"), rows


@pytest.mark.parametrize(
    "rows_limit,bytes_limit,threshold",
    [(500_000, 1 << 28, "10MB"), (0, 1 << 28, "10MB"), (500_000, 0, "-1")],
)
def test_tile_join_equals_brute_force(spark, monkeypatch, rows_limit, bytes_limit, threshold):
    monkeypatch.setattr(tiles, "BROADCAST_ROWS", rows_limit)
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", bytes_limit)
    rng = random.Random(9)
    points = [(i, rng.uniform(-74.2, -73.3), rng.uniform(45.3, 45.8)) for i in range(400)]
    points += [(1_000 + i, -73.56, 45.50) for i in range(300)]
    df = spark.createDataFrame(points, "pid long, longitude double, latitude double")
    boxes, rows = _random_boxes(spark, 120)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=threshold):
        found = [(r["query_id"], r["pid"]) for r in points_in_boxes(boxes, df).collect()]
    expected = {
        (q[0], p[0]) for q in rows for p in points if q[1] <= p[1] <= q[3] and q[2] <= p[2] <= q[4]
    }
    assert len(found) == len(set(found)) and set(found) == expected


def test_boundaries_belong_to_the_box(spark):
    points = spark.createDataFrame([(-73.97, 45.41), (-73.48, 45.70)], "longitude double, latitude double")
    boxes = spark.createDataFrame(
        [(0, -73.97, 45.41, -73.48, 45.70), (1, -73.97, 45.41, -73.97, 45.41)],
        "query_id long, min_lon double, min_lat double, max_lon double, max_lat double",
    )
    found = points_in_boxes(boxes, points).groupBy("query_id").count()
    assert {tuple(r) for r in found.collect()} == {(0, 2), (1, 1)}


def test_grid_fitted_to_the_points(spark):
    points = spark.createDataFrame([(10.0, 50.0), (20.0, 60.0), (15.0, 55.0)], "longitude double, latitude double")
    grid = Grid.covering(points)
    assert grid.bounds == (10.0, 50.0, 20.0, 60.0)
    boxes = spark.createDataFrame(
        [(0, 14.0, 54.0, 16.0, 56.0)],
        "query_id long, min_lon double, min_lat double, max_lon double, max_lat double",
    )
    assert points_in_boxes(boxes, points, grid).count() == 1
    assert Grid.covering(points.where("longitude > 99")) == Grid()


def test_cells_follow_the_bits(spark):
    grid = Grid((0.0, 0.0, 65536.0, 65536.0))
    rng = random.Random(1)
    pairs = [(rng.randrange(65536), rng.randrange(65536)) for _ in range(50)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pairs], "x double, y double")
    cells = [r[0] for r in df.select(grid.cell(F.col("x"), F.col("y"))).collect()]
    for (x, y), cell in zip(pairs, cells):
        assert cell == sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(16))


def test_centroids_do_not_depend_on_partitioning(spark):
    points = spark.range(3_000).select(
        (F.lit(-73.9) + F.col("id") / 9_000.7).alias("longitude"),
        (F.lit(45.41) + F.col("id") / 12_000.3).alias("latitude"),
    )
    results = [
        sorted(tuple(r) for r in cluster_points(points.repartition(n), (9, 14)).collect())
        for n in (1, 7)
    ]
    assert results[0] == results[1]
    assert sum(r[3] for r in results[0]) == 6_000


def test_one_hot_description_is_split_and_answered_once(spark, tmp_path):
    periods = spark.range(300).select(
        F.lit("HOT").alias("place_id"), F.col("id").alias("first_period"),
        F.format_string("%02d:00:00", F.col("id") % 12).alias("start_time"),
        F.format_string("20:%02d:%02d", F.col("id") % 60, F.floor(F.col("id") / 60)).alias("end_time"),
        (F.col("id") % 12).cast("double").alias("start_hour"), F.lit(20.0).alias("end_hour"),
        F.lit(127).cast("bigint").alias("weekday_mask"), F.lit("same").alias("description"),
        (F.col("id") + 1).alias("n_links"),
    ).select(*schemas.SPOT_PERIODS.names)
    places = spark.createDataFrame([("HOT", "-73.63", "45.54", "1", "T", "S")], schemas.RAW_PLACES)
    B.build_spots(places, periods, periods_per_row=10).write.parquet(str(tmp_path / "spots"))
    spots = spark.read.schema(schemas.SPOTS).parquet(str(tmp_path / "spots"))
    sizes = [r[0] for r in spots.select(F.size("periods")).collect()]
    assert sum(sizes) == 300 and max(sizes) < 30 and len(sizes) > 20
    assert spots.select(F.explode("periods.n_links").alias("n")).agg(F.sum("n")).first()[0] == 300 * 301 // 2
    answered = SP.query_spots(spots, SpotQuery(fixtures.BOX, hour=(13, 14), day=(1, 1)))
    rows = answered.collect()
    assert [t for r in rows for t in r["periods"]] == ["same"] and not any(r["is_currently_free"] for r in rows)
    geojson.write_features(answered, geojson.spot_feature(), str(tmp_path / "features"))
    back = geojson.read_features(spark, str(tmp_path / "features"), geojson.SPOT_PART_PROPERTIES)
    assert back.where("part_no = 0").count() == 1 and back.where("n_parts = 30").count() == len(sizes)


def test_files_of_numbered_signs_do_not_overlap(spark, tmp_path):
    signs = spark.range(20_000).select(
        ((F.col("id") * 7919) % 20_011 / 1_000.0).alias("longitude"), F.lit(45.5).alias("latitude"),
        F.lit("a").alias("arrondissement"), F.lit("0").alias("fleche"), F.lit(0).cast("bigint").alias("code_id"),
        F.lit("other").alias("category"), F.lit(False).alias("is_reserved"),
    )
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        curated.write_table(
            number_rows(signs, ["longitude"], "sign_id", slice_column=curated.SLICE), str(tmp_path), "signs"
        )
    back = curated.read_table(spark, str(tmp_path), "signs")
    assert back.columns == schemas.SIGNS.names
    files = back.groupBy(F.input_file_name()).agg(
        F.min("sign_id"), F.max("sign_id"), F.count(F.lit(1)), F.min("longitude"), F.max("longitude")
    ).collect()
    ordered = sorted(tuple(r)[1:] for r in files)
    assert len(ordered) == 8 and ordered[0][0] == 0 and ordered[-1][1] == 19_999
    assert all(a[1] + 1 == b[0] and a[4] <= b[3] for a, b in zip(ordered, ordered[1:]))
    assert all(r[1] - r[0] + 1 == r[2] for r in ordered)


def test_boxes_of_another_city_meet_in_many_tiles(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(2.2, 2.5), rng.uniform(48.8, 48.9)) for i in range(400)]
    points = spark.createDataFrame(rows, "pid long, longitude double, latitude double")
    boxes = [(i, x, y, x + 0.01, y + 0.01) for i, x, y in rows[:100]] + [(100, -500.0, 48.0, 500.0, 49.0)]
    asked = spark.createDataFrame(
        boxes, "query_id long, min_lon double, min_lat double, max_lon double, max_lat double"
    )
    tiled = tiles.TiledBoxes(asked)
    assert tiled._boxes.select("_tile").distinct().count() > 50
    found = Counter((r["query_id"], r["pid"]) for r in tiled.meet(points).collect())
    assert found == Counter(
        (q, p) for q, west, south, east, north in boxes for p, x, y in rows
        if west <= x <= east and south <= y <= north
    )


def test_a_wide_box_adds_no_points_to_the_other_levels(spark):
    points = spark.createDataFrame([(-73.9, 45.45), (-73.5, 45.65)], "longitude double, latitude double")
    boxes = spark.createDataFrame(
        [(0, -73.901, 45.449, -73.899, 45.451), (1, -73.97, 45.41, -73.48, 45.70)],
        "query_id long, min_lon double, min_lat double, max_lon double, max_lat double",
    )
    found = tiles.TiledBoxes(boxes).meet(points)
    assert sorted((r["query_id"], r["longitude"]) for r in found.collect()) == [(0, -73.9), (1, -73.9), (1, -73.5)]


@pytest.mark.parametrize("max_level", [4, 16])
def test_points_far_from_all_boxes_get_no_row(spark, max_level):
    """Two boxes in opposite corners: their common area holds all points, their squares hardly any."""
    grid, draw = Grid(max_level=max_level, min_level=2), random.Random(6)
    west, south, east, north = grid.bounds
    points = [(i, draw.uniform(west, east), draw.uniform(south, north)) for i in range(4_000)]
    corners = [(west, south, west + 0.004, south + 0.003), (east - 0.004, north - 0.003, east, north)]
    boxes = spark.createDataFrame(
        [(i, *box) for i, box in enumerate(corners)], "query_id long, min_lon double, min_lat double, max_lon double, max_lat double"
    )
    frame = spark.createDataFrame(points + [(9_999, west + 0.001, south + 0.001)], "id long, longitude double, latitude double")
    tiled = tiles.TiledBoxes(boxes, grid)
    assert tiled.tiles_of(frame).count() < 150
    found = {(r["query_id"], r["id"]) for r in tiled.meet(frame).collect()}
    assert found == {
        (q, i) for q, box in enumerate(corners) for i, lon, lat in [*points, (9_999, west + 0.001, south + 0.001)]
        if box[0] <= lon <= box[2] and box[1] <= lat <= box[3]
    }
    assert (0, 9_999) in found

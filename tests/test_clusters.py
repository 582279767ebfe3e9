"""Clusters within a radius against a greedy loop."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators.clusters import RADIUS
from kerbside.operators.radius_clusters import SEED, radius_clusters


def position(point, zoom):
    world = 256.0 * 2**zoom
    angle = math.radians(point[1])
    return (point[0] + 180) / 360 * world, (0.5 - math.log(math.tan(math.pi / 4 + angle / 2)) / (2 * math.pi)) * world


def mark(point_id):
    return hashlib.md5(f"{SEED}:{point_id}".encode()).hexdigest()


def greedy(points, zoom):
    """points: id -> (longitude, latitude, n). Centres with what they stand for, by a loop in the fixed order."""
    centres, at = {}, {}
    for i in sorted(points, key=lambda i: (mark(i), i)):
        x, y = position(points[i], zoom)
        owner = next((c for c in centres if (at[c][0] - x) ** 2 + (at[c][1] - y) ** 2 <= RADIUS**2), None)
        if owner is None:
            centres[i], at[i] = [0, 0], (x, y)
            owner = i
        centres[owner][0] += points[i][2]
        centres[owner][1] += 1
    return centres


def frame(spark, points):
    return spark.createDataFrame([(i, *p) for i, p in points.items()], "sign_id long, longitude double, latitude double")


def scattered(n, seed=5):
    draw = random.Random(seed)
    return {i: (draw.uniform(-73.62, -73.60), draw.uniform(45.50, 45.51)) for i in range(n)}


def expected(points, zooms):
    level = {i: (*p, 1) for i, p in points.items()}
    out = []
    for zoom in range(16, min(zooms) - 1, -1):
        centres = greedy(level, zoom)
        if zoom in zooms:
            out += [(zoom, i, *points[i], n, members) for i, (n, members) in centres.items()]
        level = {i: (*points[i], n) for i, (n, _) in centres.items()}
    return sorted(out)


@pytest.mark.parametrize("zooms", [(16,), (15, 13)])
def test_centres_are_those_of_the_greedy_loop(spark, zooms):
    points = scattered(300)
    points |= {1000 + i: points[i] for i in range(20)}  # equal places
    found = radius_clusters(frame(spark, points), "sign_id", zooms).collect()
    assert sorted(map(tuple, found)) == expected(points, zooms)


def test_one_crowded_square_among_others(spark):
    points = scattered(60)
    points |= {100 + i: (-73.61 + (i % 7) * 1e-6, 45.505) for i in range(600)}
    found = radius_clusters(frame(spark, points), "sign_id", (16,))
    assert sorted(map(tuple, found.collect())) == expected(points, (16,))
    assert found.agg(F.sum("n_points")).first()[0] == len(points)


def test_points_pass_through_and_nulls_and_no_rows(spark):
    rows = [(1, -73.6, 45.5), (2, -73.6, 45.5), (3, None, 45.5)]
    points = spark.createDataFrame(rows, "sign_id long, longitude double, latitude double")
    found = radius_clusters(points, "sign_id", (17, 16)).collect()
    assert sorted((r.zoom, r.n_points) for r in found) == [(16, 2), (17, 1), (17, 1)]
    assert radius_clusters(points.where("sign_id > 5"), "sign_id", (16, 14)).count() == 0

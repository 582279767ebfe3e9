import json

import pytest
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.operators.viewport import result_sizes
from kerbside.plans import display, report
from kerbside.operators import viewport
from kerbside.plans import signs as S
from kerbside.plans import spots as SP
from kerbside.plans.markers import marker_layers
from kerbside.plans.requests import SignQuery, SpotQuery
from kerbside.sources import geojson
from tests import fixtures
from tests.fixtures import BOX


@pytest.fixture(scope="module")
def tables(spark):
    return fixtures.curated(spark)


def ids(df):
    return {row["sign_id"] for row in df.collect()}


BOTH = ("permitted", "prohibited")
CASES = [
    (SignQuery(BOX, categories=BOTH), {0, 1, 2}),
    (SignQuery(BOX), {0, 1}),
    (SignQuery(BOX, reserved=True), {1}),
    (SignQuery(BOX, reserved=False), {0}),
    (SignQuery(BOX, hour=(10, 11), day=(1, 4)), {0, 1}),
    (SignQuery(BOX, hour=(20, 21), day=(1, 4)), {1}),
    (SignQuery(BOX, hour=(20, 21), day=(1, 4), not_in_range=True), {0}),
    (SignQuery(BOX, not_in_range=True), set()),
    (SignQuery(BOX, categories=()), set()),
    (SignQuery((-73.62, 45.53, -73.64, 45.55)), set()),
    (SignQuery((-73.631, 45.541, -73.631, 45.541)), {0}),
    (SignQuery((-180.0, -90.0, 180.0, 90.0)), {0, 1, 3}),
]


@pytest.mark.parametrize("query,expected", CASES)
def test_single_sign_query(tables, query, expected):
    assert ids(S.query_signs(tables.signs, tables.codes, query)) == expected


def query_rows(spark, queries):
    def row(i, q):
        hour, day, month = q.hour or (None, None), q.day or (None, None), q.month or (None, None)
        numbers = [None if x is None else float(x) for x in hour]
        categories = list(getattr(q, "categories", ["permitted"]))
        return (
            i, *q.bbox, *numbers, *day, *month, categories,
            getattr(q, "reserved", None), getattr(q, "not_in_range", False),
        )

    return spark.createDataFrame([row(i, q) for i, q in enumerate(queries)], schemas.QUERIES)


def test_batch_equals_single_queries(spark, tables):
    asked = query_rows(spark, [q for q, _ in CASES])
    answers = S.query_signs_batch(asked, tables.signs, tables.codes).collect()
    for i, (_, expected) in enumerate(CASES):
        assert {r["sign_id"] for r in answers if r["query_id"] == i} == expected
    assert len(answers) == sum(len(expected) for _, expected in CASES)


def test_batch_defaults(spark, tables):
    asked = query_rows(spark, [SignQuery(BOX)]).withColumns(
        {
            "categories": F.lit(None).cast("array<string>"),
            "not_in_range": F.lit(None).cast("boolean"),
        }
    )
    assert ids(S.query_signs_batch(asked, tables.signs, tables.codes)) == {0, 1}


def test_empty_batch(spark, tables):
    asked = query_rows(spark, [SignQuery(BOX)]).where("query_id < 0")
    assert S.query_signs_batch(asked, tables.signs, tables.codes).count() == 0


def test_regex_and_all_mode(tables):
    found = S.query_signs(
        tables.signs, tables.codes, SignQuery(BOX, categories=None), regex=S.PERMITTED_UNRESERVED
    )
    assert ids(found) == {0}
    anything = SignQuery(BOX, hour=(10, 11), day=(2, 2), categories=BOTH)
    assert ids(S.query_signs(tables.signs, tables.codes, anything, mode="all")) == {0}


SPOT_CASES = [
    (SpotQuery(BOX, hour=(10, 11), day=(1, 4)), {"S1": False, "S2": True, "S3": True}),
    (SpotQuery(BOX, hour=(20, 21), day=(1, 4)), {"S1": True, "S2": True, "S3": True}),
    (SpotQuery(BOX, hour=(10, 11), day=(6, 7)), {"S1": True, "S2": True, "S3": True}),
    (SpotQuery(BOX, hour=(10, 11)), {"S1": True, "S2": True, "S3": True}),
    (SpotQuery(BOX, day=(1, 4)), {"S1": True, "S2": True, "S3": True}),
]


@pytest.mark.parametrize("query,expected", SPOT_CASES)
def test_single_spot_query(tables, query, expected):
    answered = SP.query_spots(tables.spots, query)
    assert {r["place_id"]: r["is_currently_free"] for r in answered.collect()} == expected


def test_batch_spots(spark, tables):
    asked = query_rows(spark, [q for q, _ in SPOT_CASES])
    answers = SP.query_spots_batch(asked, tables.spots).collect()
    for i, (_, expected) in enumerate(SPOT_CASES):
        mine = [r for r in answers if r["query_id"] == i]
        assert {r["place_id"]: r["is_currently_free"] for r in mine} == expected
        assert len(mine) == len(expected)


def test_result_sizes(tables):
    found = S.query_signs(tables.signs, tables.codes, SignQuery(BOX))
    answered = SP.query_spots(tables.spots, SpotQuery(BOX))
    sizes = [result_sizes(found, answered, limit).first() for limit in (4, 5)]
    assert [(r["total"], r["refused"]) for r in sizes] == [(5, True), (5, False)]


def test_request_parameters():
    corners = dict(min_lon=1.0, min_lat=2.0, max_lon=3.0, max_lat=4.0)
    asked = SignQuery.from_parameters(**corners, hour_start=8, hour_end=9, reserved=True)
    assert asked.bbox == (1.0, 2.0, 3.0, 4.0) and asked.hour == (8, 9)
    assert asked.day == (None, None) and asked.window().day is None
    assert asked.reserved and asked.categories == ("permitted",)


def test_marker_layers(tables):
    view = SpotQuery(BOX, hour=(10, 11), day=(2, 2), month=(7, 7))
    rows = marker_layers(tables, view).collect()
    assert sorted((r["kind"], r["label"]) for r in rows) == [
        ("free", ""),
        ("free", ""),
        ("paid", "mon,tue,wed,thu: 08:00:00-20:00:00"),
        ("sign", r"\P 7h30-12h LUN A JEU"),
    ]
    assert marker_layers(tables, view, include_signs=False).count() == 3
    assert marker_layers(tables, view, include_signs=False, include_spots=False).count() == 0


def test_sign_feature_keeps_nulls(tables):
    found = S.query_signs(tables.signs, tables.codes, SignQuery(BOX, categories=("prohibited",)))
    feature = json.loads(found.select(geojson.sign_feature()).first()[0])
    assert feature == {
        "type": "Feature",
        "geometry": {"type": "Point", "coordinates": [-73.634, 45.544]},
        "properties": {
            "sign_id": 2,
            "category": "prohibited",
            "is_reserved": False,
            "arrondissement": None,
            "description": r"\A EN TOUT TEMPS",
        },
    }


def test_spot_feature(tables):
    answered = SP.query_spots(tables.spots, SpotQuery(BOX, hour=(10, 11), day=(1, 4)))
    feature = json.loads(answered.where("place_id = 'S1'").select(geojson.spot_feature()).first()[0])
    assert feature["properties"] == {
        "place_id": "S1",
        "is_currently_free": False,
        "tariff_hourly": 225.0,
        "spot_type": "Normal",
        "street": "Rue Ontario",
        "periods": ["LUN-JEU 8-20"],
    }


def test_popups(spark):
    row = spark.range(1).select(
        display.sign_popup(F.lit("permitted"), F.lit("a < b & c > d")),
        display.spot_popup(F.lit(True), F.lit("Rue <X>"), F.array(F.lit("a&b"), F.lit("c"))),
        display.spot_popup(F.lit(False), F.lit(None).cast("string"), F.array().cast("array<string>")),
        display.sign_color(F.lit("other")),
        display.spot_color(F.lit(False)),
    ).first()
    assert tuple(row) == (
        '<b class="capitalize">permitted</b><br>a &lt; b &amp; c &gt; d',
        "<b>Free now</b><br>Rue &lt;X&gt;<hr>a&amp;b<br>c",
        "<b>Paid now</b>",
        "#9ca3af",
        "#f59e0b",
    )


def test_report(tables):
    found = {r["measure"]: r["n"] for r in report.quality_report(tables).collect()}
    assert found == {
        "codes": 3,
        "signs": 4,
        "reserved_signs": 1,
        "other_signs": 0,
        "permitted_signs": 3,
        "prohibited_signs": 1,
        "spots": 3,
        "spots_with_periods": 2,
        "incomplete_periods": 0,
    }


def test_an_answer_over_the_limit_is_refused_without_a_count(spark, tables):
    found = S.query_signs(tables.signs, tables.codes, SignQuery(BOX, categories=None))
    n = found.count()
    assert viewport.is_over(found, n - 1) and not viewport.is_over(found, n)
    many = spark.range(10**9, numPartitions=1000)
    assert viewport.is_over(many, 1_000)

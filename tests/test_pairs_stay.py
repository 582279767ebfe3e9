"""Batch answers shuffle boxes and points, never their pairs; tables that grow are not broadcast."""

from pyspark.sql import functions as F

from kerbside.operators import tiles
from kerbside.operators.time_index import TimeIndex
from kerbside.plans import build as B
from kerbside import schemas
from kerbside.plans import signs as S
from kerbside.plans import spots as SP
from kerbside.plans.requests import SignQuery, SpotQuery
from kerbside.streaming import status
from tests import fixtures
from tests.fixtures import BOX
from tests.test_queries import query_rows
from tests.test_time_index import codes, signatures


def _physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _first_join(df):
    return next(line for line in _physical(df).splitlines() if "Join" in line)


def test_index_words_are_not_broadcast(spark):
    index = TimeIndex(codes(spark))
    pairs = signatures(spark).select(F.col("hour_start").alias("q_start"), F.col("hour_end").alias("q_end"))
    plan = _physical(index.axes["hour"].hits(pairs.dropna().distinct(), False))
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 3


def test_asked_pairs_are_not_broadcast_with_all_words(spark):
    """Only the signatures are broadcast; a pair that meets every word of the dictionary is not."""
    for mode in ("any", "all"):
        plan = _physical(TimeIndex(codes(spark)).words_in(signatures(spark), mode))
        assert plan.count("BroadcastHashJoin") == 1 and plan.count("explode(") == 3


def test_sign_pairs_meet_last(spark):
    tables = fixtures.curated(spark)
    asked = query_rows(spark, [SignQuery(BOX, hour=(10, 11), day=(1, 4))])
    for mode in ("any", "all"):
        assert "_tile" in _first_join(S.query_signs_batch(asked, tables.signs, tables.codes, mode=mode))


def _split_spots(spark, path):
    periods = [
        ("HOT", i, f"{i % 20:02d}:00:00", "22:00:00", float(i % 20), 22.0, 1 + i % 127, f"d{i % 7}", 1)
        for i in range(60)
    ] + [("A", 0, "09:00:00", "12:00:00", 9.0, 12.0, 127, "a", 1)]
    places = [(p, "-73.63", "45.54", "1", "T", "S") for p in ("HOT", "A", "EMPTY")]
    B.build_spots(
        spark.createDataFrame(places, schemas.RAW_PLACES),
        spark.createDataFrame(periods, schemas.SPOT_PERIODS),
        periods_per_row=10,
    ).write.parquet(path)
    return spark.read.schema(schemas.SPOTS).parquet(path)


def test_split_spots_meet_last_and_answer_alike(spark, tmp_path, monkeypatch):
    spots = _split_spots(spark, str(tmp_path / "spots"))
    windows = [((h, h + 1), (d, d)) for h in range(0, 23, 4) for d in (1, 5)]
    asked = query_rows(spark, [SpotQuery(BOX, hour=hour, day=day) for hour, day in windows])
    found = SP.query_spots_batch(asked, spots)
    assert "_tile" in _first_join(found)
    answers = sorted(map(repr, found.collect()))
    monkeypatch.setattr(SP, "TIMES_PER_ROW", 1)  # every split spot is put together per query
    assert answers == sorted(map(repr, SP.query_spots_batch(asked, spots).collect()))
    single = [
        repr((i, row["place_id"], row["part_no"], row["is_currently_free"], sorted(row["periods"])))
        for i, (hour, day) in enumerate(windows)
        for row in SP.query_spots(spots, SpotQuery(BOX, hour=hour, day=day)).collect()
    ]
    batch = [
        repr((r["query_id"], r["place_id"], r["part_no"], r["is_currently_free"], sorted(r["periods"])))
        for r in found.collect()
    ]
    assert sorted(batch) == sorted(single)


def test_texts_stay_out_of_the_status_join(spark, tmp_path):
    spots = _split_spots(spark, str(tmp_path / "spots"))
    moments = spark.createDataFrame([("HOT", "2024-01-01 10:00:00")], "place_id string, at string")
    plan = status.place_statuses(moments, spots)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join"):]
    assert "transform(periods" in joined


def test_points_are_not_broadcast(spark, monkeypatch):
    """However small their files: here the boxes are too many to broadcast and the spots a few KB."""
    monkeypatch.setattr(tiles, "BROADCAST_ROWS", 0)
    asked = query_rows(spark, [SpotQuery(BOX, hour=(10, 11), day=(1, 1))])
    found = SP.query_spots_batch(asked, fixtures.curated(spark).spots)
    assert "SortMergeJoin" in _first_join(found) and "Broadcast" not in _physical(found)
    assert found.count() > 0

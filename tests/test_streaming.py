"""Changes of places over a replayed stream of files against the table they came from."""

import datetime as dt
import random

import pytest

from kerbside import schemas
from kerbside.streaming import status
from kerbside.streaming.status import changes, place_statuses, write_changes

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "place_id string, at timestamp"


@pytest.fixture(scope="module")
def spots(spark):
    day, night = (9.0, 17.5, 0b0011111, "Day", 1), (22.0, 6.0, 0b1111111, "Night", 1)
    rows = [("A", [day]), ("B", [day, night]), ("C", None), ("D", [])]
    whole = [(p, -73.6, 45.5, 1.0, "T", "S", periods, 0, 1) for p, periods in rows]
    split = [("E", -73.6, 45.5, 1.0, "T", "S", [p], i, 2) for i, p in enumerate([day, night])]
    return spark.createDataFrame(whole + split, schemas.SPOTS)


def moments(n, seed=1):
    draw = random.Random(seed)
    return [
        (draw.choice("ABCDEX"), DAY + dt.timedelta(seconds=draw.randrange(5 * 24 * 3600), microseconds=draw.randrange(10**6)))
        for _ in range(n)
    ]


def replay(spark, folder, files, spots, delay):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"{i:03d}"))
    stream = (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(str(folder / "in"))
    )
    write_changes(place_statuses(stream, spots), delay, str(folder / "out"), str(folder / "state")).awaitTermination()
    return spark.read.schema(status.CHANGE).parquet(str(folder / "out"))


def last_tick(rows):
    """A moment far ahead lets the watermark pass all others."""
    return [("A", max(r[1] for r in rows) + dt.timedelta(days=30))]


def found(frame, until=None):
    return sorted(tuple(r) for r in frame.select("place_id", "at_us", "is_free").collect() if until is None or r.at_us <= until)


def test_status_of_moments(spark, spots):
    rows = [("A", DAY.replace(hour=10)), ("A", DAY.replace(hour=20)), ("E", DAY.replace(hour=23)), ("X", DAY), ("C", DAY), ("A", None)]
    got = {(r.place_id, r.at_us): r.is_free for r in changes(place_statuses(spark.createDataFrame(rows, SCHEMA), spots)).collect()}
    at = lambda i: int(rows[i][1].timestamp() * 1e6)
    assert got == {("A", at(0)): False, ("A", at(1)): True, ("E", at(2)): False, ("C", at(4)): True}


def test_late_rows_change_nothing(spark, spots, tmp_path):
    rows = moments(400)
    rows += rows[:10]
    by_time = sorted(rows, key=lambda r: r[1])
    draw = random.Random(2)
    # every row up to five hours late, in twelve files
    arrival = sorted(by_time, key=lambda r: r[1] + dt.timedelta(hours=draw.uniform(0, 5)))
    files = [arrival[i : i + 35] for i in range(0, len(arrival), 35)] + [last_tick(rows)]
    got = replay(spark, tmp_path, files, spots, "6 hours")
    until = int(max(r[1] for r in rows).timestamp() * 1e6)
    expected = found(changes(place_statuses(spark.createDataFrame(rows, SCHEMA), spots)))
    assert found(got, until) == expected and len(expected) > 20


def test_rows_behind_the_watermark_are_dropped(spark, spots, tmp_path):
    early, late = ("A", DAY.replace(hour=10)), ("A", DAY.replace(hour=9, minute=30))
    files = [[early], [("A", DAY + dt.timedelta(days=1, hours=20))], [("A", DAY + dt.timedelta(days=1, hours=21))], [late]]
    files.append([("A", DAY + dt.timedelta(days=9))])
    got = found(replay(spark, tmp_path, files, spots, "1 hour"))
    assert (late[0], int(late[1].timestamp() * 1e6), False) not in got
    assert (early[0], int(early[1].timestamp() * 1e6), False) in got

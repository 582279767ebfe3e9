import itertools

from pyspark.sql import functions as F

from kerbside.functions import periods as P
from tests.model import contained, spans


def test_every_mask(spark):
    rows = spark.range(128).select("id", P.mask_day_ranges(F.col("id")).alias("r")).collect()
    for row in rows:
        assert [tuple(r) for r in row["r"]] == spans(row["id"])


def test_mask_covers_every_query(spark):
    days = spark.range(-6, 10)
    grid = spark.range(128).toDF("mask").crossJoin(days.toDF("s")).crossJoin(days.toDF("e"))
    hits = grid.select(
        "mask", "s", "e", P.mask_covers(F.col("mask"), F.col("s"), F.col("e")).alias("hit")
    ).collect()
    found = {tuple(r)[:3]: r["hit"] for r in hits}
    for mask, s, e in itertools.product(range(128), range(-6, 10), range(-6, 10)):
        assert found[(mask, s, e)] == any(contained((s, e), p, 7) for p in spans(mask)), (mask, s, e)


def test_fractional_days_go_through_the_spans(spark):
    hit = P.mask_covers(F.lit(0b0000110).cast("bigint"), F.lit(2.5), F.lit(3.0))
    assert spark.range(1).select(hit).first()[0] is True


PERIOD = "array<struct<start_hour:double,end_hour:double,weekday_mask:bigint,description:string>>"


def _free(spark, periods, hour, day):
    df = spark.createDataFrame([(periods,)], f"p {PERIOD}")
    lit = lambda pair: None if pair is None else (F.lit(float(pair[0])), F.lit(float(pair[1])))
    return df.select(P.is_free(F.col("p"), lit(hour), lit(day))).first()[0]


def test_free(spark):
    period = [(9.0, 18.0, 0b0011111, "x")]
    assert _free(spark, [], (10, 11), (1, 5))
    assert _free(spark, None, (10, 11), (1, 5))
    assert not _free(spark, period, (10, 11), (1, 5))
    assert _free(spark, period, (20, 21), (1, 5))
    assert _free(spark, period, (10, 11), (6, 7))
    assert _free(spark, period, (10, 11), None)
    assert _free(spark, period, None, (1, 5))


def test_null_period_values_cover_nothing(spark):
    assert _free(spark, [(None, 18.0, 127, "x"), (9.0, 18.0, None, "y")], (10, 11), (1, 1))
    assert not _free(spark, [(None, 18.0, 127, "x"), (9.0, 18.0, 127, "y")], (10, 11), (1, 1))


def test_last_minute_ignores_seconds(spark):
    hours = [P.clock_hours(F.lit("23:59:59")), P.clock_hours(F.lit("23:59:59"), keep_seconds=True)]
    plain, exact = spark.range(1).select(*hours).first()
    assert plain == 23 + 59 / 60.0
    assert exact == 23 + 59 / 60.0 + 59 / 3600.0
    assert _free(spark, [(22.0, plain, 127, "x")], (22, 24), (1, 1))


def test_descriptions_keep_first_appearance(spark):
    rows = [([(1.0, 2.0, 1, "b"), (1.0, 3.0, 1, "a"), (2.0, 3.0, 1, "b"), (2.0, 3.0, 1, None)],)]
    df = spark.createDataFrame(rows, f"p {PERIOD}")
    assert df.select(P.descriptions(F.col("p"))).first()[0] == ["b", "a", None]


def test_labels(spark):
    df = spark.createDataFrame([(0b11,), (0,), (127,)], "m bigint")
    label = P.period_label(F.col("m"), F.lit("09:00:00"), F.lit("18:00:00"))
    assert [r[0] for r in df.select(label).collect()] == [
        "mon,tue: 09:00:00-18:00:00",
        "",
        "mon,tue,wed,thu,fri,sat,sun: 09:00:00-18:00:00",
    ]

import itertools
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.functions import intervals as I
from kerbside.functions.intervals import TimeWindow, in_force, matches, matches_all, within
from tests.model import contained

ROWS = [
    ((9, 10), (8, 11), 24, True),
    ((9, 12), (8, 11), 24, False),
    ((23, 2), (22, 7), 24, True),
    ((8, 9), (22, 7), 24, False),
    ((5, 23), (22, 7), 24, True),
    ((9, 17), (17, 9), 24, True),
    ((22, 7), (0, 24), 24, False),
    ((1, 1), (6, 1), 7, True),
    ((6, 1), (1, 7), 7, False),
    ((11, 3), (1, 12), 12, False),
]


@pytest.mark.parametrize("q,p,base,expected", ROWS)
def test_known_rows(spark, q, p, base, expected):
    ends = [F.lit(float(x)) for x in (*q, *p)]
    assert spark.range(1).select(within(*ends, base)).first()[0] is expected
    assert contained(q, p, base) is expected


@pytest.mark.parametrize("base", [7, 12])
@pytest.mark.parametrize("strict", [False, True])
def test_every_integer_combination(spark, base, strict):
    numbers = spark.range(0, base + 1).select(F.col("id").cast("double").alias("x"))
    grid = numbers.toDF("qs")
    for name in ("qe", "ps", "pe"):
        grid = grid.crossJoin(numbers.toDF(name))
    bounds = [F.col(c) for c in ("qs", "qe", "ps", "pe")]
    found = {
        tuple(row)[:4]: row["hit"]
        for row in grid.withColumn("hit", within(*bounds, base, strict)).collect()
    }
    for qs, qe, ps, pe in itertools.product(range(base + 1), repeat=4):
        assert found[(qs, qe, ps, pe)] == contained((qs, qe), (ps, pe), base, strict)


def _code(spark, hours=(), days=(), months=(), chained_days=False):
    rows = [(0, "X", "", "other", False, list(hours), list(days), list(months), chained_days, False)]
    return spark.createDataFrame(rows, schemas.CODES)


def _active(code, **window):
    return code.select(in_force(TimeWindow.literal(**window))).first()[0]


def test_one_of_several_ranges_is_enough(spark):
    code = _code(spark, hours=[(6.0, 10.5), (21.0, 5.0)])
    found = [_active(code, hour=w) for w in ((6.5, 9), (22, 4), (4, 6.5), (11, 12))]
    assert found == [True, True, False, False]


def test_every_asked_dimension_has_to_hold(spark):
    code = _code(spark, hours=[(10.0, 14.5)], days=[(2, 4)])
    windows = [((11, 14), (3, 4)), ((11, 14), (4, 5)), ((9, 14), (3, 4)), ((9, 14), (5, 5))]
    assert [_active(code, hour=h, day=d) for h, d in windows] == [True, False, False, False]
    assert _active(_code(spark), hour=(3, 5), day=(7, 1), month=(6, 9))


def test_half_given_dimension_is_off(spark):
    assert _active(_code(spark, hours=[(8.0, 18.0)]), hour=(20, None))


def test_negation_flips_each_answer(spark):
    code = _code(spark, hours=[(13.0, 16.0)], days=[(6, 7)])
    for window in (dict(hour=(14, 15)), dict(hour=(15, 17)), dict(hour=(14, 15), day=(5, 6))):
        asked = TimeWindow.literal(**window)
        plain, negated = code.select(matches(asked, F.lit(False)), matches(asked, F.lit(True))).first()
        assert plain != negated


def test_null_ranges_count_as_none(spark):
    rows = [(0, "X", "", "other", False, None, None, None, False, False)]
    code = spark.createDataFrame(rows, schemas.CODES)
    assert _active(code, hour=(9, 10))
    assert not code.select(matches_all(TimeWindow.literal(hour=(9, 10)), F.lit(False))).first()[0]


@pytest.mark.parametrize(
    "code,window,negate,expected",
    [
        (dict(hours=[(7.0, 19.0), (22.0, 7.0)]), dict(hour=(23, 2)), False, False),
        (dict(hours=[(7.0, 19.0), (8.0, 20.0)]), dict(hour=(9, 10)), False, True),
        (dict(hours=[(7.0, 19.0), (22.0, 7.0)]), dict(hour=(20, 21)), True, True),
        (dict(), dict(hour=(9, 10)), False, False),
        (dict(), dict(hour=(9, 10)), True, False),
        (dict(days=[(1, 5)]), dict(hour=(9, 10)), False, True),
        (dict(days=[(1, 5)], chained_days=True), dict(day=(2, 2)), False, False),
        (dict(days=[(1, 5)], chained_days=True), dict(hour=(2, 3)), False, True),
    ],
)
def test_all_mode(spark, code, window, negate, expected):
    test = matches_all(TimeWindow.literal(**window), F.lit(negate))
    assert _code(spark, **code).select(test).first()[0] is expected


@pytest.mark.parametrize("size, strict", [(7, False), (7, True), (12, False), (12, True)])
def test_plain_containment_is_the_columns_one(spark, size, strict):
    pairs = [(a, b) for a in range(1, size + 1) for b in range(1, size + 1)]
    rows = [(*q, *p) for q in pairs for p in pairs]
    frame = spark.createDataFrame(
        [tuple(map(float, r)) for r in rows], "qs double, qe double, ps double, pe double"
    )
    found = frame.select(I.within(F.col("qs"), F.col("qe"), F.col("ps"), F.col("pe"), float(size), strict)).collect()
    assert [r[0] for r in found] == [I.contains(r[:2], r[2:], size, strict) for r in rows]


@pytest.mark.parametrize("size", [7, 12])
def test_truth_bits_are_the_predicates(spark, size):
    draw = random.Random(size)
    lists = [[]] + [
        [(draw.randint(1, size), draw.randint(1, size)) for _ in range(draw.randint(1, 3))] for _ in range(25)
    ]
    pairs = [(a, b) for a in range(1, size + 1) for b in range(1, size + 1)]
    rows = [(ranges, float(s), float(e)) for ranges in [*lists, None] for s, e in pairs]
    frame = spark.createDataFrame(rows, "ranges array<struct<start:bigint,end:bigint>>, s double, e double")
    ends, bits = (F.col("s"), F.col("e")), I.truth_bitmaps(F.col("ranges"), size)
    checks = []
    for strict in (False, True):
        checks.append(I.truth_bit(bits, ends, size, "any", strict) == I.any_within(*ends, F.col("ranges"), size, strict))
        every = I.all_within(*ends, F.col("ranges"), size, F.lit(False), strict)
        checks.append(I.truth_bit(bits, ends, size, "all", strict) == every)
        none = I.all_within(*ends, F.col("ranges"), size, F.lit(True), strict)
        checks.append((F.col("ranges").isNotNull() & ~I.truth_bit(bits, ends, size, "any", strict)) == none)
    assert frame.where(~reduce(lambda a, b: a & b, checks)).count() == 0


def test_windows_know_which_ends_are_on_their_axis(spark):
    assert I.TimeWindow.literal(day=(1, 7), month=(0, 4)).listed == {"day"}
    assert I.TimeWindow.literal(day=(1.5, 2), month=(12, 1)).listed == {"month"}
    assert I.TimeWindow.literal(day=(None, 3)).listed == frozenset()
    schema = "day_start long, day_end long, month_start long, month_end long"
    on, off = (1, 7, None, 12), (0, 3, 1, 1)
    assert I.listed_dimensions(spark.createDataFrame([on], schema)) == {"day", "month"}
    assert I.listed_dimensions(spark.createDataFrame([on, off], schema)) == {"month"}
    assert I.listed_dimensions(spark.createDataFrame([], schema)) == {"day", "month"}

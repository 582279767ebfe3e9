"""Matches found through elementary intervals against the predicates."""

import random

import pytest
from pyspark.sql import functions as F

from kerbside.functions.intervals import TimeWindow, matches, matches_all
from kerbside.operators.time_index import SIGNATURE, TimeIndex

RANGE = "array<struct<start:{0},end:{0}>>"
CODES = (
    f"code_id long, hour_ranges {RANGE.format('double')}, day_ranges {RANGE.format('bigint')}, "
    f"month_ranges {RANGE.format('bigint')}, chained_days boolean, chained_months boolean"
)
QUERIES = (
    "hour_start double, hour_end double, day_start long, day_end long, month_start long, month_end long, "
    "not_in_range boolean"
)


def codes(spark, n=150):
    draw = random.Random(1)

    def ranges(kind, low, high, most):
        value = (lambda: draw.randint(low * 60, high * 60) / 60.0) if kind is float else (lambda: draw.randint(low, high))
        return [(value(), value()) for _ in range(draw.choice([0, 1, 1, 2, most]))]

    rows = [
        (i, ranges(float, 0, 26, 4), ranges(int, 1, 7, 3), ranges(int, 1, 12, 2), i % 9 == 0, i % 11 == 0)
        for i in range(n)
    ]
    rows[7] = (7, [(24 + 1 / 3, 0.5), (0.0, 24 + 1 / 3)], [], [], False, False)
    return spark.createDataFrame(rows, CODES)


def signatures(spark, n=120):
    draw = random.Random(2)

    def pair(values):
        kind = draw.random()
        return (None, None) if kind < 0.2 else (values(), None) if kind < 0.25 else (values(), values())

    rows = [
        (*pair(lambda: draw.choice([draw.randint(0, 24 * 60) / 60.0, 1 / 3, draw.uniform(0, 24)])),
         *pair(lambda: draw.randint(0, 8)), *pair(lambda: draw.randint(0, 13)), draw.choice([True, False, None]))
        for _ in range(n)
    ]
    rows += [rows[0], (1 / 3, 0.2, None, None, None, None, False), (None,) * 7]
    return spark.createDataFrame(rows, QUERIES)


def plain(spark, table, queries, mode, strict):
    """Each signature against each code."""
    test = {"any": matches, "all": matches_all}[mode]
    for name in ("hour", "day", "month"):
        both = F.col(f"{name}_start").isNotNull() & F.col(f"{name}_end").isNotNull()
        queries = queries.withColumns({f"{name}_{e}": F.when(both, F.col(f"{name}_{e}")) for e in ("start", "end")})
    asked = queries.withColumn("not_in_range", F.coalesce("not_in_range", F.lit(False))).distinct()
    passed = test(TimeWindow.columns(), F.col("not_in_range"), strict)
    return asked.crossJoin(table).where(passed).select(*SIGNATURE, "not_in_range", "code_id")


@pytest.mark.parametrize("mode", ["any", "all"])
@pytest.mark.parametrize("strict", [False, True])
def test_index_answers_as_the_predicates(spark, mode, strict):
    table, queries = codes(spark), signatures(spark)
    index = TimeIndex(table)
    found = sorted(map(repr, index.codes_in(queries, mode, strict).collect()))
    assert found == sorted(map(repr, plain(spark, table, queries, mode, strict).collect()))
    assert len(found) > 500


def test_no_pair_product_in_the_plan(spark):
    found = TimeIndex(codes(spark)).codes_in(signatures(spark))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_to_ask_or_to_find(spark):
    index = TimeIndex(codes(spark))
    assert index.codes_in(signatures(spark).limit(0)).count() == 0
    assert TimeIndex(codes(spark).limit(0)).codes_in(signatures(spark)).count() == 0

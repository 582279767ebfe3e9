import pytest
from pyspark.sql import functions as F

from kerbside.functions import text_ranges as text
from kerbside.plans.build import parse_codes


def parse(spark, description, ignore_case=False):
    pairs = spark.createDataFrame([("C", description)], "code_rpa string, description string")
    return parse_codes(pairs, ignore_case).first()


def pairs(ranges):
    return [tuple(r) for r in ranges]


@pytest.mark.parametrize(
    "description,hours",
    [
        (r"\P 8h30-11h30 MERCREDI", [(8.5, 11.5)]),
        (r"\P 9h30-18h EXCEPTE", [(9.5, 18.0)]),
        (r"\P 07h-19h CLIGNOTANT 22h-07h FIXE", [(7.0, 19.0), (22.0, 7.0)]),
        (r"\A EN TOUT TEMPS", []),
        ("9H-17H", []),
        ("9h - 17h", []),
        ("123h-17h", [(23.0, 17.0)]),
        (None, []),
    ],
)
def test_hours(spark, description, hours):
    assert pairs(parse(spark, description)["hour_ranges"]) == hours


def test_hours_in_any_case(spark):
    assert pairs(parse(spark, "9H-17h30", ignore_case=True)["hour_ranges"]) == [(9.0, 17.5)]


@pytest.mark.parametrize(
    "description,days,months",
    [
        (r"\A RESERVE AUTOBUS 07h-09h30 LUN. AU VEN.", [(1, 5)], []),
        (r"\P 13h-15h30 MARDI VENDREDI", [(2, 2), (5, 5)], []),
        (r"\P 8h30-11h30 MERCREDI 1 AVRIL AU 1 DEC", [(3, 3)], [(4, 12)]),
        (r"\A 7h-18h LUN A VEN SEPT A JUIN", [(1, 5)], [(9, 6)]),
        (r"\P 1 AVR AU 1 DEC", [], [(4, 12)]),
        (r"\A RESERVE AUTOBUS SCOLAIRE MARDI", [(2, 2)], []),
        ("LUN A MER A VEN", [(1, 5)], []),
        ("MAR", [(2, 2)], []),
        ("MARS", [], [(3, 3)]),
        ("LUNDI A ET MERCREDI", [(1, 3)], []),
        ("A LUNDI MARDI", [(1, 1), (2, 2)], []),
        ("LUN A MAI VEN", [(1, 1), (5, 5)], [(5, 5)]),
        ("LUN MAI A VEN", [(1, 5)], [(5, 5)]),
        ("PRÉAU LUN MAR", [(1, 1), (2, 2)], []),
        ("LUN PRÉAU VEN", [(1, 1), (5, 5)], []),
        ("lundi au Vendredi", [(1, 5)], []),
        ("", [], []),
        (None, [], []),
    ],
)
def test_days_and_months(spark, description, days, months):
    row = parse(spark, description)
    assert pairs(row["day_ranges"]) == days
    assert pairs(row["month_ranges"]) == months


def test_chains(spark):
    row = parse(spark, "LUN A MER A VEN MAI A JUIN")
    assert row["chained_days"] and not row["chained_months"]


@pytest.mark.parametrize(
    "description,category,reserved",
    [
        (r"\P EN TOUT TEMPS", "permitted", False),
        (r"\A EN TOUT TEMPS", "prohibited", False),
        (r"\A RESERVE AUTOBUS", "prohibited", True),
        ("INTERDICTION DE STAT. S3R", "other", False),
        (" \t \\P x", "permitted", False),
        (r"\p x", "other", False),
        (r"x \P", "other", False),
        ("réservé", "other", False),
        ("reserve", "other", True),
        (None, "other", False),
    ],
)
def test_classify(spark, description, category, reserved):
    row = parse(spark, description)
    assert (row["category"], row["is_reserved"]) == (category, reserved)


def test_null_text_gives_empty_description(spark):
    assert parse(spark, None)["description"] == ""


def test_long_text_is_read_to_its_end(spark):
    long_text = "mot " * 50_000 + "LUN A VEN 9h-17h"
    row = spark.createDataFrame([(long_text,)], "t string").select(
        text.hour_ranges(F.col("t")), text.day_month_ranges(F.col("t"))
    ).first()
    assert pairs(row[0]) == [(9.0, 17.0)]
    assert [tuple(r) for r in row[1]["days"]] == [(1, 5, 2)]

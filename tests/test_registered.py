"""Every registered query against its SQL, and the shape of the plans."""

import os

import pytest

from __spark_entry__ import entry
from checks.compare import compare, connect
from checks.oracles import oracles as oracle_sql
from checks.queries import REGISTRY, SIGN_QUERIES
from kerbside.operators import tiles
from kerbside.plans.prepared import curated_tables

FOLDER = "/root/testdata/sf0.001"


def queries():
    return REGISTRY


pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_against_sql(spark, con, name):
    assert compare(spark, con, FOLDER, queries()[name], oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry(spark).columns[0] == "sign_id"


def _plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.mark.parametrize("name", sorted(queries()))
def test_plans_stay_native_and_free_of_pair_products(spark, name):
    plan = _plan(queries()[name](spark, FOLDER))
    for operator in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_viewport_filters_reach_the_scan(spark):
    plan = _plan(queries()["sign_query_time"](spark, FOLDER))
    for pushed in (
        "GreaterThanOrEqual(longitude,-73.75)",
        "LessThanOrEqual(latitude,45.6)",
        "EqualTo(category,permitted)",
    ):
        assert pushed in plan
    assert "fleche" not in plan


def test_spot_queries_are_one_scan_when_no_spot_is_split(spark):
    plan = _plan(queries()["spot_query_free"](spark, FOLDER), "simple")
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Union" not in plan


def test_tables_are_built_once_per_input_state(spark):
    assert curated_tables(spark, FOLDER) is curated_tables(spark, FOLDER)


@pytest.mark.parametrize("name", ["batch_sign_query", "batch_spot_query", "sign_query_time"])
def test_same_answers_without_broadcasts(spark, con, monkeypatch, name):
    monkeypatch.setattr(tiles, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert compare(spark, con, FOLDER, queries()[name], oracle_sql()[name]) == ""
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_single_query_is_registered():
    assert set(SIGN_QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(n for n, (asked, _) in SIGN_QUERIES.items() if asked.day or asked.month))
def test_days_and_months_are_answered_by_a_shift(spark, name):
    """Lambdas over ranges are left for hours only."""
    plan = _plan(queries()[name](spark, FOLDER), "extended")
    for ranges in ("day_ranges", "month_ranges"):
        assert f"exists({ranges}" not in plan and f"forall({ranges}" not in plan


def test_a_viewport_opens_only_its_files(spark):
    tables = curated_tables(spark, FOLDER)
    for box in ((-73.5001, 45.41, -73.5, 45.4101), (-80.0, 40.0, -79.0, 41.0)):
        met = tables.sign_slices.met_by(box)
        assert len(met) < len(tables.sign_slices.files)
        assert set(tables.signs_near(box).inputFiles()) <= set(tables.signs.inputFiles())

"""Rebuilds under readers, and what a failed build leaves."""

import os

import pytest
from pyspark.sql import functions as F

from kerbside.plans import build as B
from kerbside.sources import curated, versions
from tests.test_build import FILES


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw-versions")
    for name, content in FILES.items():
        (folder / name).write_bytes(content.encode("cp1252"))
    return B.read_raw(spark, str(folder))


def test_a_reader_opened_before_a_rebuild_ends_right(spark, raw, tmp_path):
    folder = str(tmp_path)
    B.build(spark, raw, folder)
    reader = curated.load(spark, folder)
    before = sorted(map(repr, reader.signs.collect()))
    fewer = B.RawTables(
        raw.signs.where("CODE_RPA is null"), raw.places, raw.place_links, raw.period_links, raw.periods, raw.regulations
    )
    B.build(spark, fewer, folder)
    assert sorted(map(repr, reader.signs.collect())) == before and before
    assert sorted(map(repr, reader.signs_near((-74.0, 45.0, -73.0, 46.0)).collect())) == before
    assert curated.load(spark, folder).signs.count() == 0


def test_a_failed_build_is_not_published(spark, raw, tmp_path):
    folder = str(tmp_path)
    B.build(spark, raw, folder)
    first = versions.published(spark, folder)
    broken = B.RawTables(
        raw.signs.withColumn("Longitude", F.lit("not a number")), raw.places, raw.place_links, raw.period_links,
        raw.periods, raw.regulations,
    )
    with pytest.raises(Exception):
        B.build(spark, broken, folder)
    assert versions.published(spark, folder) == first
    assert curated.load(spark, folder).signs.count() == 8


def test_prune_keeps_the_last_versions(spark, raw, tmp_path):
    folder = str(tmp_path)
    for _ in range(3):
        B.build(spark, raw, folder)
    every = versions.published(spark, folder)
    assert len(every) == 3 and versions.prune(spark, folder) == every[:1]
    assert versions.published(spark, folder) == every[1:]
    assert not os.path.exists(every[0]) and os.path.exists(every[1])
    assert curated.load(spark, folder).codes.count() == 5


def test_a_folder_without_versions_is_read_as_it_is(spark, raw, tmp_path):
    B.build(spark, raw, str(tmp_path / "a"))
    version = versions.current(spark, str(tmp_path / "a"))
    os.rename(version, tmp_path / "plain")
    assert versions.current(spark, str(tmp_path / "plain")) == str(tmp_path / "plain")
    moved = curated.load(spark, str(tmp_path / "plain"))
    assert moved.codes.count() == 5
    assert moved.signs_near((-73.7, 45.4, -73.5, 45.6)).count() > 0

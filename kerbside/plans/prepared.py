"""Curated tables of a star-schema folder, built once per application and input state."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kerbside.plans.build import build
from kerbside.sources import star_schema
from kerbside.sources.curated import Curated
from kerbside.storage import fingerprint, new_path, on_removal

_INPUTS = ("lineitem", "part", "orders", "customer")
_built: dict[tuple, Curated] = {}
on_removal.append(_built.clear)


def curated_tables(spark: SparkSession, folder: str) -> Curated:
    """Build on first use, then read the written tables again until an input file changes."""
    state = fingerprint(spark, *star_schema.table_paths(folder, *_INPUTS))
    key = (spark.sparkContext.applicationId, folder, state)
    if key not in _built:
        _built[key] = build(
            spark, star_schema.raw_tables(spark, folder), new_path(spark, "curated")
        )
    return _built[key]

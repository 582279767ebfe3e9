"""Build the curated tables: python -m kerbside RAW_FOLDER CURATED_FOLDER

Uses the session that spark-submit or the cluster provides.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kerbside.plans.build import build, read_raw
from kerbside.plans.report import category_counts, quality_report


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kerbside", description="Build the curated tables.")
    parser.add_argument("raw", help="folder of the municipal CSV files")
    parser.add_argument("curated", help="folder for the curated Parquet tables")
    parser.add_argument("--ignore-case", action="store_true", help="also read 9H-17H as hours")
    parser.add_argument("--via-regulations", action="store_true")
    parser.add_argument("--keep-seconds", action="store_true")
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("kerbside-build").getOrCreate()
    tables = build(
        spark,
        read_raw(spark, options.raw),
        options.curated,
        ignore_case=options.ignore_case,
        via_regulations=options.via_regulations,
        keep_seconds=options.keep_seconds,
    )
    category_counts(tables.signs).show()
    quality_report(tables).show(truncate=False)


if __name__ == "__main__":
    main()

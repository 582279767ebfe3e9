"""Quality report of the curated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.sources.curated import Curated


def category_counts(signs: DataFrame) -> DataFrame:
    return signs.groupBy("category").agg(F.count(F.lit(1)).alias("n_signs")).orderBy("category")


def quality_report(tables: Curated) -> DataFrame:
    """Rows of (measure, n): table sizes, signs per category, reserved signs, spots with
    periods, and periods that can never cover a query because a value is null."""
    def measures(df: DataFrame, **columns) -> DataFrame:
        row = df.agg(*[column.alias(name) for name, column in columns.items()])
        return row.unpivot([], list(columns), "measure", "n")

    codes = measures(tables.codes, codes=F.count(F.lit(1)))
    signs = measures(
        tables.signs,
        signs=F.count(F.lit(1)),
        reserved_signs=F.count_if("is_reserved"),
        **{
            f"{name}_signs": F.count_if(F.col("category") == name)
            for name in ("other", "permitted", "prohibited")
        },
    )
    first = F.col("part_no") == 0
    spots = measures(
        tables.spots,
        spots=F.count_if(first),
        spots_with_periods=F.count_if(first & F.col("periods").isNotNull()),
    )
    incomplete = F.col("start_hour").isNull() | F.col("end_hour").isNull() | F.col(
        "weekday_mask"
    ).isNull()
    periods = measures(tables.spot_periods, incomplete_periods=F.count_if(incomplete))
    return codes.unionByName(signs).unionByName(spots).unionByName(periods)

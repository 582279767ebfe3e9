"""Which paid spots are free inside an area during a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import periods as P
from kerbside.functions.grid import Grid
from kerbside.functions.intervals import TimeWindow
from kerbside.operators.lists import bounded_lists
from kerbside.operators.tiles import TiledBoxes
from kerbside.operators.viewport import in_bbox
from kerbside.plans.requests import SpotQuery
from kerbside.storage import written

_ANSWER = [
    "place_id",
    "longitude",
    "latitude",
    "tariff_hourly",
    "spot_type",
    "street",
    "is_currently_free",
    "periods",
    "part_no",
    "n_parts",
]

# A split spot with more distinct times (hours and weekdays of its periods) is answered from all its rows together.
TIMES_PER_ROW = 1_000


def _owned(parts: DataFrame, spot: list[str]) -> DataFrame:
    """The descriptions of each part that occur in no earlier part of its spot, in order, as ``_owned``."""
    return (
        parts.select(*spot, "part_no", F.posexplode("periods").alias("_place", "_text"))
        .groupBy(*spot, "_text")
        .agg(F.min(F.struct("part_no", "_place")).alias("_first"))
        .groupBy(*spot, F.col("_first.part_no").alias("part_no"))
        .agg(F.array_sort(F.collect_list(F.struct("_first._place", "_text"))).alias("_owned"))
    )


def _owned_texts() -> Column:
    return F.coalesce(F.col("_owned._text"), F.array().cast("array<string>"))


def _answer(
    whole: DataFrame,
    parts: DataFrame,
    window: TimeWindow,
    strict: bool,
    keys: list[str],
    needed: Column | None = None,
) -> DataFrame:
    """Spots with their status and their distinct period descriptions.

    Almost every spot is one curated row (``whole``) and is answered by a projection. A spot
    whose list spans several curated rows (``parts``) keeps them: all carry the status of the
    whole spot, each its own share of the descriptions, and part_no 0 stands for the spot. A
    description that occurs in several parts stays in the first of them.
    """

    def answered(spots: DataFrame) -> DataFrame:
        return spots.withColumn(
            "is_currently_free", P.is_free(F.col("periods"), window.hour, window.day, strict, needed)
        ).withColumn("periods", P.descriptions(F.col("periods")))

    parts = answered(parts)
    spot, part = [*keys, "place_id"], [*keys, "place_id", "part_no"]
    status = parts.groupBy(*spot).agg(F.bool_and("is_currently_free").alias("is_currently_free"))
    combined = (
        parts.drop("is_currently_free", "periods")
        .join(status, spot)
        .join(_owned(parts, spot), part, "left")
        .withColumn("periods", _owned_texts())
    )
    return answered(whole).select(*keys, *_ANSWER).unionByName(combined.select(*keys, *_ANSWER))


def query_spots(spots: DataFrame, query: SpotQuery, strict: bool = False) -> DataFrame:
    """Spots of the viewport, free and paid alike.

    The status is computed only when the query has both hours and days; otherwise every
    spot counts as free. Months play no part.
    """
    seen = spots.where(in_bbox(query.bbox))
    one_row = F.col("n_parts") == 1  # reaches the scan, which skips row groups without split spots
    return _answer(seen.where(one_row), seen.where(~one_row), query.window(), strict, [])


def _with_times(split: DataFrame) -> DataFrame:
    """Split spots with the distinct times of the whole spot as ``_times`` (null if there are more than
    ``TIMES_PER_ROW``) and each part's own descriptions as ``periods``. None of this depends on a query."""
    each = split.select("place_id", F.explode(P.covering(F.col("periods"))).alias("_time")).distinct()
    lists = bounded_lists(written(each, "times"), ["place_id"], F.col("_time"), "_times", TIMES_PER_ROW)
    few = lists.where(F.col("n_parts") == 1).select("place_id", "_times")
    described = split.withColumn("periods", P.descriptions(F.col("periods")))
    return (
        described.join(few, "place_id", "left")
        .join(_owned(described, ["place_id"]), ["place_id", "part_no"], "left")
        .withColumn("periods", _owned_texts())
        .drop("_owned")
    )


def query_spots_batch(
    queries: DataFrame, spots: DataFrame, grid: Grid | None = None, strict: bool = False
) -> DataFrame:
    """Answers of many query rows by one job: one row per (query_id, spot).

    Descriptions and times are made once per spot, before it meets the boxes, so the pairs are neither shuffled
    nor written. Only split spots with more than ``TIMES_PER_ROW`` distinct times have their status put together
    per query.
    """
    window = TimeWindow(
        hour=(F.col("hour_start"), F.col("hour_end")), day=(F.col("day_start"), F.col("day_end"))
    )
    asked = queries.select(
        "query_id",
        "min_lon",
        "min_lat",
        "max_lon",
        "max_lat",
        "hour_start",
        "hour_end",
        "day_start",
        "day_end",
        P.needed_days(*window.day).alias("_needed"),
    )
    tiled = TiledBoxes(asked, grid)
    one_row = F.col("n_parts") == 1
    split = written(spots.where(~one_row), "split-spots")
    timed = written(_with_times(split), "timed-spots")
    whole = (
        spots.where(one_row)
        .withColumn("_times", P.covering(F.col("periods")))
        .withColumn("periods", P.descriptions(F.col("periods")))
    )
    free = P.is_free(F.col("_times"), window.hour, window.day, strict, F.col("_needed"))
    answered = (
        tiled.meet(whole.unionByName(timed.where(F.col("_times").isNotNull())))
        .withColumn("is_currently_free", free)
        .select("query_id", *_ANSWER)
    )
    many = timed.where(F.col("_times").isNull()).select("place_id").distinct()
    if many.isEmpty():
        return answered
    parts = written(tiled.meet(split.join(many, "place_id", "left_semi")), "met-spots")  # used three times
    rest = _answer(parts.where(F.lit(False)), parts, window, strict, ["query_id"], F.col("_needed"))
    return answered.unionByName(rest)


def split_spots(answered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The free spots and the paid ones."""
    return (
        answered.where(F.col("is_currently_free")),
        answered.where(~F.col("is_currently_free")),
    )


def spot_labels(spot_periods: DataFrame) -> DataFrame:
    """Per place the distinct non-empty period labels, sorted and joined by `` | ``."""
    label = P.period_label(F.col("weekday_mask"), F.col("start_time"), F.col("end_time"))
    return (
        spot_periods.select("place_id", label.alias("label"))
        .groupBy("place_id")
        .agg(F.collect_set(F.when(F.col("label") != "", F.col("label"))).alias("labels"))
        .select("place_id", F.array_join(F.array_sort("labels"), " | ").alias("label"))
    )

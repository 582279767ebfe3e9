"""When places turn free or paid, from a table or a stream of moments.

``place_statuses`` is a projection over a join with the curated spots and runs on a streaming DataFrame
unchanged. Changes need the moment before: over a table that is a window, over a stream the state of a
place. A place's state holds its last reported status and the moments that are still waiting for earlier
ones; when the watermark passes them they are put in order and compared. So moments may come late by up to
the delay and in any order, and the stream's changes are those of the table; later ones are dropped, as by
any watermark. State per place is bounded by the moments of one delay.

The first known status of a place counts as a change. Equal moments of a place are one moment. Moments
without a place, a place without a curated spot, and null moments report nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbside.functions import moments as M
from kerbside.functions import periods as P

CHANGE = "place_id string, at_us long, is_free boolean"
_STATE = "at_us array<bigint>, is_free array<boolean>, last boolean"


def place_statuses(moments: DataFrame, spots: DataFrame, strict: bool = False) -> DataFrame:
    """place_id, at (timestamp) and is_free for moments (place_id, at). A spot that spans several curated rows
    gives one row for each, and the place is free when all of them say so."""
    at = F.col("at").cast("timestamp")
    hour, day = M.hour_of_day(at), M.day_of_week(at)
    asked = moments.where(F.col("at").isNotNull()).select(
        F.col("place_id").alias("_place"), at.alias("at"), hour.alias("_hour"), day.alias("_day")
    )
    window = (F.col("_hour"), F.col("_hour")), (F.col("_day"), F.col("_day"))
    # texts and counts stay out of the join
    known = spots.select("place_id", P.covering(F.col("periods")).alias("periods"))
    return asked.join(known, F.col("_place") == F.col("place_id")).select(
        "place_id", "at", P.is_free(F.col("periods"), *window, strict).alias("is_free")
    )


def changes(statuses: DataFrame) -> DataFrame:
    """place_id, at_us (microseconds since 1970) and is_free of the moments at which a place's status differs from
    that of the moment before; over a table."""
    each = statuses.groupBy("place_id", F.unix_micros("at").alias("at_us")).agg(
        F.bool_and("is_free").alias("is_free")
    )
    before = F.lag("is_free").over(Window.partitionBy("place_id").orderBy("at_us"))
    return (
        each.withColumn("_before", before)
        .where(F.col("_before").isNull() | (F.col("_before") != F.col("is_free")))
        .drop("_before")
    )


def _place_changes(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    times, values, last = state.get if state.exists else ([], [], None)
    held = dict(zip(times, values))
    for batch in batches:
        for at, free in zip(batch["at_us"].tolist(), batch["is_free"].tolist()):
            held[at] = held.get(at, True) and free
    passed = state.getCurrentWatermarkMs() * 1_000
    found = []
    for at in sorted(t for t in held if t <= passed):
        free = held.pop(at)
        if free != last:
            found.append((key[0], at, free))
            last = free
    waiting = sorted(held)
    state.update((waiting, [held[t] for t in waiting], last))
    if waiting:
        # the first millisecond at which the watermark has passed the earliest of them
        state.setTimeoutTimestamp(waiting[0] // 1_000 + 1)
    yield pd.DataFrame(found, columns=["place_id", "at_us", "is_free"])


def changes_of_stream(statuses: DataFrame, delay: str) -> DataFrame:
    """``changes`` over a stream whose moments come late by up to ``delay``, to be written in append mode."""
    return (
        statuses.withWatermark("at", delay)
        .withColumn("at_us", F.unix_micros("at"))
        .groupBy("place_id")
        .applyInPandasWithState(
            _place_changes, CHANGE, _STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def write_changes(statuses: DataFrame, delay: str, path: str, checkpoint: str):
    """Start writing the changes of a stream to Parquet files; all that has come in by now, then it ends."""
    return (
        changes_of_stream(statuses, delay)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )

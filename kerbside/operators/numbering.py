"""Dense row numbers in a global order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.storage import written


def _positions(df: DataFrame, keys: list[str]) -> DataFrame:
    return (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_position", F.monotonically_increasing_id())
    )


def number_rows(
    df: DataFrame,
    order: list[str],
    id_column: str,
    copy_column: str | None = None,
    slice_column: str | None = None,
) -> DataFrame:
    """Number the rows 0, 1, 2, ... by ``order``; the result is range-partitioned and sorted.

    One range shuffle sorts the rows and the sorted table is written with a position per
    row; a second, narrow pass adds the number of rows in the partitions before. The counts
    have one row per written partition, which bounds both the window and the broadcast.

    ``copy_column`` tells rows apart that agree on all of ``order``, so that many copies of
    one row still split over partitions. It is used for placing only and then dropped.

    ``slice_column`` adds the number of the sorted partition a row comes from. The second pass may
    read several of these in one task; a writer that keeps slices apart restores the layout.
    """
    keys = [*order, copy_column] if copy_column else list(order)
    placed = _positions(df, keys)
    if copy_column:
        placed = placed.drop(copy_column)
    table = written(placed, "numbered")

    # A position is (partition << 33) + row within the partition.
    partition = F.shiftright("_position", 33)
    row = F.col("_position").bitwiseAND(F.lit((1 << 33) - 1))
    counts = table.groupBy(partition.alias("_partition")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_partition", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    numbered = (
        table.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")
        .withColumn(id_column, F.col("_offset") + row)
    )
    if slice_column:
        numbered = numbered.withColumn(slice_column, F.col("_partition").cast("int"))
    return numbered.drop("_partition", "_offset", "_position")

"""Grouping into lists whose length does not grow with the largest group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.storage import written


def bounded_lists(
    rows: DataFrame,
    keys: list[str],
    item: Column,
    name: str,
    limit: int,
) -> DataFrame:
    """Sorted lists of the items of each key: keys, n_parts, part_no and the list.

    A key with more than ``limit`` items is spread over ``n_parts`` rows of about that many
    items each, so no task ever gathers a whole hot key. Items must be distinct within a
    key, and ``rows`` should be a written table because it is read twice. Parts are counted
    from 0, and every key has its part 0.

    The keys over the limit are written first: there are few of them, and from the real
    size of that table the planner decides by itself whether to broadcast it.
    """
    rows = rows.withColumn("_item", item)
    place = F.xxhash64("_item")
    sizes = rows.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(limit)).alias("n_parts"), F.min(place).alias("_anchor")
    )
    long_keys = written(sizes.where(F.col("n_parts") > 1), "long-keys")
    n_parts, anchor = F.col("n_parts"), F.col("_anchor")
    part_no = F.pmod(F.pmod(place, n_parts) - F.pmod(anchor, n_parts), n_parts)
    named = long_keys.withColumnsRenamed({key: f"_long_{key}" for key in keys})
    same_key = [F.col(key).eqNullSafe(F.col(f"_long_{key}")) for key in keys]  # null is a key too
    parted = rows.join(named, same_key, "left").withColumns(
        {
            "part_no": F.coalesce(part_no, F.lit(0).cast("bigint")),
            "n_parts": F.coalesce(n_parts, F.lit(1).cast("bigint")),
        }
    )
    return (
        parted.repartition(*keys, "part_no")
        .groupBy(*keys, "n_parts", "part_no")
        .agg(F.array_sort(F.collect_list("_item")).alias(name))
    )

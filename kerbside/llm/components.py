"""Connected components by alternating stars: every round is joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import Steps


def _signature(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))
        ).first()
    )


def connected_components(
    edges: DataFrame, steps: Steps, name: str, rows: int | None = None
) -> DataFrame:
    """node, component (the smallest node reachable) of every node with an edge (a, b).

    Each round first ties every larger neighbour of a node to the node's smallest neighbour, then
    every smaller one; edges never grow in number, and a component becomes a star around its
    smallest node. Minima are pre-aggregated, and a node with very many edges only meets its one
    minimum again, in a join that Spark may split. Self-loops and repeated edges count for nothing.
    ``rows`` is about the number of edges, if it is known.
    """
    now = steps.keep(
        edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(),
        f"{name}_0",
        rows,
    )
    state, turn = _signature(now), 0
    while state[0]:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
            now.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("lo"))
        large = (
            both.filter("v > u").join(smallest, "u").select("lo", F.col("v").alias("hi")).distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = large.join(least, "hi")
        small = (
            tied.filter("lo <> m")
            .select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .unionAll(least.select(F.col("m").alias("lo"), "hi"))
            .distinct()
        )
        then = steps.keep(small, f"{name}_{turn + 1}", rows=state[0])
        before, state = state, _signature(then)
        steps.drop(f"{name}_{turn}")
        now, turn = then, turn + 1
        if state == before:
            break
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    centres = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.unionAll(centres)

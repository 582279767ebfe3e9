"""Mixing sources to target weights: Sainte-Lague apportionment of equal blocks of words.

Sources, ordered by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share the words of
all documents; a share stops at ``MOST_REPEATS`` times the source's own size, and what is cut off
goes to the others by weight until no share is above its stop.

The shares are dealt as blocks of ``block`` words. Every shard takes the same number of blocks
(one more or less at the end), given to the sources by the highest quotients
share / (2 * blocks held + 1), so each shard has integer quotas and all shards together have the
Sainte-Lague apportionment (it never takes a block back as the number grows). Sources at their
stop take all of their words and are spread evenly over the shards.

Documents of a source lie in seeded hash order along one circle of words; its blocks are cut from
the circle one after the other, from a seeded start, and pass over it again when a source takes
more than it has. A document's words are therefore taken at most ``MOST_REPEATS`` times, and a
run of blocks is a seeded choice of documents.

Everything is DataFrame expressions. Rows per source are few; documents meet each other only in
ranges of their hash (256 for each source), so a source with a third of all rows is spread
over many tasks.

Null texts have size 0 and nothing is taken from documents of size 0; a null source is a source
of its own; rows that repeat a doc_id are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import Steps

MOST_REPEATS = 3
BLOCK_WORDS = 8
SHARDS = 16
RANGE_DIGITS = 2

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _source_key() -> Column:
    """Order of sources: by code point, null last."""
    return F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name"))


def source_shares(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight and target, one row per source."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    order = Window.orderBy("key")
    weighted = per_source.withColumn("key", _source_key()).withColumn(
        "weight", (F.row_number().over(order) - 1) % 3 + 1
    )
    everything = Window.partitionBy(F.lit(0))
    filling = everything.orderBy(F.col("stop") / F.col("weight"), "key")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    return (
        weighted.withColumn("stop", F.col("source_size") * MOST_REPEATS)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full_stop", F.coalesce(F.sum("stop").over(earlier), F.lit(0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.col("full_weight"))
        # words per unit of weight, if exactly the sources before this one are at their stop
        .withColumn("level", (F.col("total") - F.col("full_stop")) / F.col("rest_weight"))
        .withColumn("is_full", F.col("stop") <= F.col("weight") * F.col("level"))
        # sources fill in this order, so the level of the first one that does not holds for all
        .withColumn("final", F.max(F.when(~F.col("is_full"), F.col("level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("is_full"), F.col("stop").cast("double")).otherwise(
                F.least(F.col("weight") * F.col("final"), F.col("stop").cast("double"))
            ),
        )
        .select("source", "key", "source_size", "weight", "target", "is_full")
    )


def shard_quotas(shares: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """source, shard (from 1), blocks the source has given up to and with that shard.

    For each shard's cumulative number of blocks, every source first gets its rounded share; the
    few blocks over or short are then given or taken by the highest quotients. Only quotients
    near the rounded share can matter, so the rows are proportional to sources x shards.
    """
    all_sources = Window.partitionBy(F.lit(0))
    held = (
        shares.filter(~F.col("is_full") & (F.col("target") > 0))
        .withColumn("sum_target", F.sum("target").over(all_sources))
        .withColumn("n_sources", F.count(F.lit(1)).over(all_sources))
        .withColumn("n_blocks", F.round(F.col("sum_target") / block).cast("long"))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("house", F.floor(F.col("n_blocks") * F.col("shard") / shards))
        .withColumn("rounded", F.round(F.col("target") * F.col("house") / F.col("sum_target")).cast("long"))
    )
    house = Window.partitionBy("shard")
    held = held.withColumn("short", F.col("house") - F.sum("rounded").over(house)).withColumn(
        "near",
        F.ceil(F.col("target") * (F.abs("short") + F.col("n_sources")) / F.col("sum_target")) + 1,
    )
    give = F.col("short") > 0
    seats = (
        held.filter(F.col("short") != 0)
        .withColumn(
            "seat",  # numbers of blocks held just before the block in question is given
            F.explode(
                F.when(give, F.sequence(F.col("rounded"), F.col("rounded") + F.col("near"))).otherwise(
                    F.sequence(F.greatest(F.col("rounded") - F.col("near"), F.lit(0).cast("long")), F.col("rounded"))
                )
            ),
        )
        .filter(give | (F.col("seat") < F.col("rounded")))
        .withColumn("quotient", F.col("target") / (2 * F.col("seat") + 1))
    )
    highest = Window.partitionBy("shard").orderBy(F.col("quotient").desc(), "key")
    lowest = Window.partitionBy("shard").orderBy(F.col("quotient"), F.col("key").desc())
    change = (
        seats.withColumn("place", F.when(give, F.row_number().over(highest)).otherwise(F.row_number().over(lowest)))
        .filter(F.col("place") <= F.abs("short"))
        .groupBy("key", "shard")
        .agg(F.sum(F.signum("short")).cast("long").alias("change"))
    )
    blocks = F.col("rounded") + F.coalesce("change", F.lit(0))
    open_sources = held.join(change, ["key", "shard"], "left").select(
        "source", "key", "shard", blocks.alias("blocks")
    )
    whole = F.ceil(F.col("source_size") * MOST_REPEATS / block)
    full_sources = (
        shares.filter(F.col("is_full") | (F.col("target") <= 0))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .select("source", "key", "shard", F.floor(whole * F.col("shard") / shards).alias("blocks"))
    )
    return open_sources.unionByName(full_sources)


def _number(*parts) -> Column:
    """A number below 16**15 from the hash of some values."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    """The whole row as one column, so no column of ``docs`` can clash with those added here."""
    whole = F.struct(*(F.col(f"`{name}`") for name in docs.columns))
    return docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), whole.alias("row")
    )


def _placed(sizes: DataFrame, steps: Steps, seed: int) -> DataFrame:
    """Adds each document's offset on its source's circle: hash order, by ranges of the hash."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id", "size"))
    placed = sizes.withColumn("order", order).withColumn("range", F.substring("order", 1, RANGE_DIGITS))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = steps.keep(
        sums.select(
            F.col("source").alias("s"),
            F.col("range").alias("r"),
            F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"),
        ),
        "mix_ranges",
    )
    before = (
        Window.partitionBy("source", "range")
        .orderBy("order", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .withColumn("offset", F.col("range_start") + F.col("within"))
        .drop("s", "r", "range", "range_start", "within", "order")
    )


def _source_plan(sizes: DataFrame, steps: Steps, seed: int, block: int, shards: int) -> DataFrame:
    """Per source: whole passes over its circle, and the run of words taken once more."""
    shares = source_shares(sizes)
    quotas = shard_quotas(shares, block, shards).groupBy("key").agg(F.max("blocks").alias("blocks"))
    size = F.col("source_size")
    words = F.least(F.col("blocks") * block, size * MOST_REPEATS)
    return steps.keep(
        shares.join(quotas, "key")
        .withColumn("words", F.when(size > 0, words).otherwise(0).cast("long"))
        .withColumn("rounds", F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0).cast("long"))
        .withColumn("run", F.col("words") - F.col("rounds") * size)
        .withColumn(
            "run_start", F.when(size > 0, F.pmod(_number(F.lit(str(seed)), "source"), size)).otherwise(0)
        )
        .select(F.col("source").alias("s"), "source_size", "target", "rounds", "run", "run_start"),
        "mix_plan",
    )


def _planned(sizes: DataFrame, plan: DataFrame, steps: Steps, seed: int) -> DataFrame:
    """What the mix takes of each document: ``rounds`` whole copies, and once more its words
    [``first``, ``first`` + ``count``) and [0, ``count2``). Both pieces exist only where the run
    ends and begins in one document."""
    placed = _placed(sizes, steps, seed).join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    end, run_end = F.col("offset") + F.col("size"), F.col("run_start") + F.col("run")
    # on the circle the run is one piece up to the circle's end, and one from its beginning
    first_from = F.greatest("offset", "run_start")
    zero = F.lit(0).cast("long")
    count = F.greatest(F.least(end, run_end, F.col("source_size")) - first_from, zero)
    count2 = F.greatest(F.least(end, run_end - F.col("source_size")) - F.col("offset"), zero)
    return (
        placed.withColumn("count", count)
        .withColumn("first", F.when(F.col("count") > 0, first_from - F.col("offset")).otherwise(zero))
        .withColumn("count2", count2)
        .withColumn(
            "taken", (F.col("rounds") * F.col("size") + F.col("count") + F.col("count2")).cast("long")
        )
    )


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), and
    ``rounds``, ``first``, ``count``, ``count2`` as in ``_planned``."""
    steps = Steps(docs.sparkSession)
    sizes = steps.keep(_sized(docs).drop("row"), "mix_sizes")
    plan = _source_plan(sizes, steps, seed, block, shards)
    return _planned(sizes, plan, steps, seed).select(
        "doc_id", "size", "source_size", "target", "taken", "rounds", "first", "count", "count2"
    )


def word_slice(text: Column, first: Column, count: Column) -> Column:
    """Words [first, first + count) of a text, each with the white space before it."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, (first + 1).cast("int"), count.cast("int")), "")


def mixed_documents(
    docs: DataFrame, seed: int = 7, block: int = BLOCK_WORDS, shards: int = SHARDS
) -> DataFrame:
    """The mix as rows with the columns of ``docs``: whole copies of documents, and parts of those
    at the ends of a run (``n_chars``, where present, follows). A document the mix takes no words
    from has no row."""
    steps = Steps(docs.sparkSession)
    sizes = steps.keep(_sized(docs).drop("row"), "mix_sizes")
    plan = _source_plan(sizes, steps, seed, block, shards)
    text, size = F.col("row.text"), F.col("size")
    whole = F.col("rounds") + F.when(F.col("count") == size, 1).otherwise(0)
    zero = F.lit(0).cast("long")
    part = F.struct(F.col("first").alias("first"), F.col("count").alias("count"))
    part2 = F.struct(zero.alias("first"), F.col("count2").alias("count"))
    nothing = F.array().cast("array<struct<first:bigint,count:bigint>>")
    copies = F.array_repeat(F.struct(zero.alias("first"), zero.alias("count")), whole.cast("int"))
    parts = F.concat(
        copies,
        F.when((F.col("count") > 0) & (F.col("count") < size), F.array(part)).otherwise(nothing),
        F.when(F.col("count2") > 0, F.array(part2)).otherwise(nothing),
    )
    rows = (
        _planned(_sized(docs), plan, steps, seed)
        .filter(F.col("taken") > 0)
        .select("row", F.explode(parts).alias("part"))
    )
    cut = F.when(F.col("part.count") == 0, text).otherwise(
        word_slice(text, F.col("part.first"), F.col("part.count"))
    )
    fresh = {"text": cut, "n_chars": F.char_length(cut).cast(docs.schema["n_chars"].dataType)} if (
        "n_chars" in docs.columns
    ) else {"text": cut}
    return rows.select(*(fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))

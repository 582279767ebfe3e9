"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes the set of its word shingles; texts with equal sets are one class.
2. Of each class only the low ``BITS`` bits of ``HASHES`` minima are kept, packed into longs,
   and ``BANDS`` band hashes, each over full minima of its own. Classes that share a band are candidates.
3. Small bands give their pairs; large ones give the pairs with their smallest member. The packed
   signatures are compared by bit counts; from the share of equal low bits the chance agreement is
   taken off, and pairs are kept down to five standard errors below the threshold.
4. Kept pairs are confirmed on the full sets. Confirmed links give components.
5. Large bands whose members are still in several components are not given up: their members are
   cut into blocks, and blocks that are not in one component are compared set by set (exactly,
   as products of incidence matrices). So a large group of copies costs no pair of rows, and no
   link is lost to the choice of the member that stands for a band.

No two bands share a minimum, so bands miss a pair independently, and a pair at the threshold shares no band with
a chance of at most ``MISS``. Nothing else is approximate.

Null texts and texts without words have no shingles and link with nothing. Rows that repeat a
doc_id are separate documents sharing that id; a component's id is its smallest doc_id that is
not null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import Steps, text_column
from kerbside.llm.components import connected_components
from kerbside.llm.text_hashes import mixed, shingles, word_hashes

WORD = r"[^\x20\x09-\x0D]"
HASHES, BITS, BANDS = 128, 4, 40
SMALL_BAND = 8
BLOCK_CLASSES, BLOCK_SHINGLES = 128, 1 << 17
MISS = 1.5e-7

_PER_LONG = 64 // BITS
_LONGS = HASHES // _PER_LONG


def band_rows(similarity: float) -> int:
    """The most minima per band that still leave a chance of at most ``MISS`` to share no band."""
    rows = 1
    while (1 - similarity ** (rows + 1)) ** BANDS <= MISS:
        rows += 1
    return rows


def least_estimate(similarity: float) -> float:
    """Five standard errors below the threshold."""
    chance = 2.0**-BITS
    equal = similarity + (1 - similarity) * chance
    return similarity - 5 * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def minima(values: np.ndarray, offsets: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Rows x hashes minima; every row holds at least one value."""
    out = np.empty((len(offsets) - 1, hashes), np.uint64)
    held = np.empty_like(values)
    odd = mixed(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1)
    plus = mixed(np.arange(1001, hashes + 1001, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for k in range(hashes):
            np.multiply(values, odd[k], out=held)
            held += plus[k]
            out[:, k] = np.minimum.reduceat(held, offsets[:-1])
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima (of their upper half, where they are well mixed), _LONGS per row."""
    low = (least >> np.uint64(32)) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return (low.reshape(len(low), _LONGS, _PER_LONG) << shifts).sum(axis=2, dtype=np.uint64)


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """Rows x BANDS hashes, each over the next ``rows`` minima."""
    out = np.empty((len(least), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            held = np.full(len(least), band + 1, np.uint64)
            for place in range(band * rows, (band + 1) * rows):
                held = mixed(held * np.uint64(3) + least[:, place])
            out[:, band] = held
    return out


def _sets(batch: pa.RecordBatch, width: int):
    """(row, sorted distinct shingles) of a batch, in runs of rows."""
    for first, last, words, offsets in word_hashes(text_column(batch)):
        yield first, [
            np.unique(shingles(words[offsets[i] : offsets[i + 1]], width)) for i in range(last - first)
        ]


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def text_key() -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64("text")


_SIGNED = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("signature", T.ArrayType(T.LongType())),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def signatures(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (names the set; null if empty), signature, bands."""
    kinds = [docs.schema["doc_id"], T.StructField("text_key", T.LongType(), False)]
    schema = T.StructType([*kinds, *_SIGNED.fields])

    def run(batches):
        for batch in batches:
            for first, own in _sets(batch, width):
                filled = [i for i, s in enumerate(own) if len(s)]
                signed, banded = [None] * len(own), [None] * len(own)
                if filled:
                    offsets = np.cumsum([0] + [len(own[i]) for i in filled])
                    least = minima(np.concatenate([own[i] for i in filled]), offsets, max(HASHES, BANDS * rows))
                    low, banded_now = packed(least[:, :HASHES]), bands(least, rows)
                    for i, s, b in zip(filled, low.view(np.int64), banded_now.view(np.int64)):
                        signed[i], banded[i] = s, b
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(own)),
                        batch.column("text_key").slice(first, len(own)),
                        pa.array([len(s) for s in own], pa.int64()),
                        pa.array([_digest(s) for s in own], pa.binary()),
                        pa.array(signed, pa.list_(pa.int64())),
                        pa.array(banded, pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node and its sorted shingles, for every text with words."""

    def run(batches):
        for batch in batches:
            for _, own in _sets(batch, width):
                filled = [s for s in own if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_digest(s) for s in filled], pa.binary()),
                        pa.array([s.view(np.int64) for s in filled], pa.list_(pa.int64())),
                    ],
                    names=["node", "shingles"],
                )

    return docs.select("text").mapInArrow(run, "node binary, shingles array<long>")


def estimated(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal low bits by bit counts, less chance."""
    ones = sum(1 << (BITS * i) for i in range(_PER_LONG))
    mask = F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones).cast("long")
    different = F.lit(0)
    for place in range(_LONGS):
        x = a.getItem(place).bitwiseXOR(b.getItem(place))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        different = different + F.bit_count(x.bitwiseAND(mask))
    chance = 2.0**-BITS
    return ((HASHES - different) / HASHES - chance) / (1 - chance)


def _linked(common: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    return 100 * common >= percent * (size_a + size_b - common)


def _block_links(percent: int):
    """For mapInArrow: links between members of different components of two blocks."""

    def matrix(block: pa.StructArray):
        sets = block.field("shingles")
        sizes = np.diff(sets.offsets.to_numpy())
        return sizes, sets.flatten().to_numpy(), np.repeat(np.arange(len(block)), sizes)

    def common(a, b, rows_a, rows_b) -> np.ndarray:
        shared = np.intersect1d(a, b)
        out = np.zeros((rows_a[-1] + 1, rows_b[-1] + 1), np.float32)
        at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
        held_a = np.append(shared, 0)[at_a] == a if len(shared) else np.zeros(len(a), bool)
        held_b = np.append(shared, 0)[at_b] == b if len(shared) else np.zeros(len(b), bool)
        for begin in range(0, len(shared), 8192):  # a slice of the shingles at a time
            grids = []
            for at, held, rows, n in ((at_a, held_a, rows_a, out.shape[0]), (at_b, held_b, rows_b, out.shape[1])):
                use = held & (at >= begin) & (at < begin + 8192)
                grid = np.zeros((n, min(8192, len(shared) - begin)), np.float32)
                grid[rows[use], at[use] - begin] = 1
                grids.append(grid)
            out += grids[0] @ grids[1].T
        return out.astype(np.int64)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # one pair of blocks at a time, as Arrow arrays
                left, right = (batch.column(side)[row].values for side in ("left", "right"))
                (size_a, a, rows_a), (size_b, b, rows_b) = matrix(left), matrix(right)
                name_a, name_b = (side.field("component").to_pylist() for side in (left, right))
                both = common(a, b, rows_a, rows_b)
                linked = 100 * both >= percent * (size_a[:, None] + size_b[None, :] - both)
                found = {}
                for i, j in zip(*np.nonzero(linked)):
                    pair = (name_a[i], name_b[j])
                    if pair[0] != pair[1]:
                        found[min(pair), max(pair)] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"]
                )

    return run


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks of the members (group, component, node): a component with many members in a group
    has blocks of its own, all others of the group are mixed. A block has about ``BLOCK_CLASSES``
    members, and fewer where these have more than ``BLOCK_SHINGLES`` shingles together."""
    share = 1 / BLOCK_CLASSES + F.size("shingles") / BLOCK_SHINGLES  # of a block
    shares = sets.select("node", share.alias("share"))
    counts = members.join(shares, "node").groupBy("group", "component").agg(F.sum("share").alias("n"))
    many = counts.filter(F.col("n") >= 1).select("group", "component", F.col("n").alias("own"))
    rest = counts.filter(F.col("n") < 1).groupBy("group").agg(F.sum("n").alias("others"))
    placed = (
        members.join(many, ["group", "component"], "left")
        .join(rest, "group", "left")
        .withColumn("part", F.when(F.col("own").isNotNull(), F.col("component")))
        .withColumn("n_blocks", F.ceil(F.coalesce("own", "others")))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    )
    return (
        placed.join(sets, "node")
        .groupBy("group", "part", "block")
        .agg(F.collect_list(F.struct("node", "component", "shingles")).alias("members"))
    )


def _rest_of_large_bands(
    members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, steps: Steps, n: int
) -> DataFrame:
    """Links (a, b) between components that share a large band, compared in blocks; ``n`` classes in all."""
    named = members.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    open_bands = (
        named.groupBy("band")
        .agg(F.min("component").alias("first"), F.max("component").alias("last"))
        .filter("first <> last")
        .select("band")
    )
    left_open = steps.keep(named.join(open_bands, "band", "left_semi"), "nd_open", n)
    rows = left_open.count()
    groups = connected_components(
        left_open.select(F.col("leader").alias("a"), F.col("node").alias("b")), steps, "nd_groups", rows
    )
    grouped = steps.keep(
        left_open.select("node", "component")
        .distinct()
        .join(groups.withColumnRenamed("component", "group"), "node"),
        "nd_grouped",
        rows,
    )
    blocks = steps.keep(_blocks(grouped, sets), "nd_blocks", rows)
    key = F.struct(F.coalesce(F.hex("part"), F.lit("")), "block")
    keyed = blocks.select("group", "part", key.alias("key"))
    a = keyed.select("group", F.col("part").alias("part_a"), F.col("key").alias("key_a"))
    b = keyed.select("group", F.col("part").alias("part_b"), F.col("key").alias("key_b"))
    # only the names of blocks meet here; blocks of one component need no comparison
    pairs = a.join(b, "group").filter(
        (F.col("key_a") <= F.col("key_b"))
        & (F.col("part_a").isNull() | F.col("part_b").isNull() | (F.col("part_a") != F.col("part_b")))
    )
    held = blocks.select("group", key.alias("key"), "members")
    full = (
        pairs.join(held.select("group", F.col("key").alias("key_a"), F.col("members").alias("left")), ["group", "key_a"])
        .join(held.select("group", F.col("key").alias("key_b"), F.col("members").alias("right")), ["group", "key_b"])
        .select("left", "right")
    )
    return full.mapInArrow(_block_links(percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key, component of every row of ``docs``.

    ``component`` names the rows reachable by links of a similarity of at least ``percent`` per
    cent; it is null without shingles."""
    spark = docs.sparkSession
    steps = Steps(spark)
    similarity = percent / 100
    signed = steps.keep(signatures(docs, width, band_rows(similarity)), "nd_signed")
    classes = steps.keep(
        signed.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.any_value("n_shingles").alias("size"),
            F.any_value("signature").alias("signature"),
            F.any_value("bands").alias("bands"),
        ),
        "nd_classes",
    )
    n = classes.count()  # from the footers
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = (
        banded.groupBy("band")
        .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"))
        .filter("n > 1")
    )
    members = steps.keep(banded.join(shared, "band"), "nd_members")
    small, large = members.filter(F.col("n") <= SMALL_BAND), members.filter(F.col("n") > SMALL_BAND)
    a, b = small.select("band", F.col("node").alias("a")), small.select("band", F.col("node").alias("b"))
    pairs = (
        a.join(b, "band")
        .filter("a < b")
        .select("a", "b")
        .unionAll(large.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")))
        .distinct()
    )
    slim = classes.select("node", "size", "signature")
    likely = steps.keep(
        rows=n,
        name="nd_pairs",
        df=pairs.join(slim.toDF("a", "size_a", "sig_a"), "a")
        .join(slim.toDF("b", "size_b", "sig_b"), "b")
        .filter(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
        .filter(estimated(F.col("sig_a"), F.col("sig_b")) >= least_estimate(similarity))
        .select("a", "b"),
    )
    needed = (
        likely.select(F.col("a").alias("node"))
        .unionAll(likely.select(F.col("b").alias("node")))
        .unionAll(large.select("node"))
        .distinct()
        .join(classes.select("node", "first_id"), "node")
    )
    ids = needed.select(F.col("first_id").alias("doc_id")).distinct()
    wanted = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    no_id = docs.select("doc_id", "text").filter(F.col("doc_id").isNull())
    sets = steps.keep(
        shingle_sets(wanted.unionByName(no_id), width)
        .join(needed.select("node"), "node", "left_semi")
        .groupBy("node")
        .agg(F.any_value("shingles").alias("shingles")),
        "nd_sets",
    )
    steps.clean()
    common = F.size(F.array_intersect("set_a", "set_b"))
    links = steps.keep(
        rows=n,
        name="nd_links",
        df=likely.join(sets.toDF("a", "set_a"), "a")
        .join(sets.toDF("b", "set_b"), "b")
        .filter(_linked(common, F.size("set_a"), F.size("set_b"), percent))
        .select("a", "b"),
    )
    steps.clean()
    labels = steps.keep(connected_components(links, steps, "nd_first", n), "nd_labels", n)
    rest = steps.keep(_rest_of_large_bands(large, labels, sets, percent, steps, n), "nd_rest", n)
    joined = connected_components(rest, steps, "nd_second", n).toDF("component", "whole")
    every = (
        classes.select("node", "first_id")
        .join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(joined, "component", "left")
        .select("node", "first_id", F.coalesce("whole", "component").alias("component"))
    )
    least = every.groupBy("component").agg(F.min("first_id").alias("component_id"))
    final = steps.keep(every.join(least, "component").select("node", "component", "component_id"), "nd_final", n)
    steps.clean()
    filled = signed.filter(F.col("node").isNotNull()).select("doc_id", "text_key", "n_shingles", "node").join(final, "node")
    empty = signed.filter(F.col("node").isNull()).select(
        "doc_id",
        "text_key",
        "n_shingles",
        "node",
        F.col("node").alias("component"),
        F.col("doc_id").alias("component_id"),
    )
    return filled.unionByName(empty).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "text_key",
        "component",
    )


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null last), then the smallest
    text key. Rows without words all stay. Columns are those of ``docs``."""
    found = near_duplicates(docs, width, percent).filter(F.col("component").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    chosen = found.groupBy("component").agg(F.min(order).alias("one")).select(
        F.col("one.doc_id").alias("i"), F.col("one.text_key").alias("k")
    )
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").alias("i"),
        text_key().alias("k"),
        F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("has_words"),
    )
    one = (
        rows.filter("has_words")
        .alias("r")
        .join(
            chosen.alias("c"),
            F.col("r.i").eqNullSafe(F.col("c.i")) & (F.col("r.k") == F.col("c.k")),
            "left_semi",
        )
        .dropDuplicates(["i", "k"])
    )
    kept = one.unionByName(rows.filter("not has_words"))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))

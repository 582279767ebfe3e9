"""Approximate nearest neighbours: a forest of random-projection trees, and exact reranking.

``TREES`` trees of ``DEPTH`` levels cut the space by random directions at the median of a sample
(at most ``FIT_VECTORS`` vectors, those of the smallest hash). Every vector of the table is then
put into its leaf of every tree. A query walks all trees through one shared priority queue, whose
priority is the smallest margin by which the way to a node misses the query, and takes leaves
until they hold ``PROBE`` of all entries, and as many different vectors as there are answers to give
(its own is one more); on a table with fewer it takes all of them. Leaves are kept as matrices of bounded size; queries
that visit a leaf meet it in chunks of bounded size, and the exact cosine in double precision
ranks all candidates.

Equal vectors are one entry that keeps its smallest ids, as many as could ever be returned, so a
vector with very many copies is one candidate, and no answer is lost.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors are compared
with those of their own length. All lengths share the trees, where shorter vectors count as zero in what they
lack, and parts beyond the longest sampled vector play no part in choosing a side; leaves are kept by length.
Ties go to the smaller id. Rows
that repeat a vec_id are different vectors, and a query never finds rows of its own id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import Steps
from kerbside.llm.vectors import content_key, matrix, unit, usable, written_out

TREES, DEPTH = 8, 6
FIT_VECTORS = 8_192
PROBE = 0.14
LEAF_ROWS, QUERY_ROWS = 512, 256


class Forest:
    """Cutting planes of all trees: node i of a tree has the children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.depth, self.inner = depth, 2**depth - 1
        self.planes = draw.standard_normal((trees, self.inner, sample.shape[1]))
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, self.inner))
        for tree in range(trees):
            held = {0: np.arange(len(sample))}
            for node in range(self.inner):
                rows = held.pop(node)
                along = sample[rows] @ self.planes[tree, node]
                self.cuts[tree, node] = np.median(along) if len(rows) else 0.0
                above = along > self.cuts[tree, node]
                held[2 * node + 1], held[2 * node + 2] = rows[~above], rows[above]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors x trees: the leaf (from 0) of each vector in each tree."""
        out = np.empty((len(vectors), len(self.planes)), np.int64)
        for tree, (planes, cuts) in enumerate(zip(self.planes, self.cuts)):
            above = vectors @ planes.T > cuts
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + above[np.arange(len(vectors)), node]
            out[:, tree] = node - self.inner
        return out

    def visits(self, vector: np.ndarray, held: np.ndarray, enough: float, least: int) -> list[tuple[int, int]]:
        """(tree, leaf) best first, until the leaves hold ``enough`` entries, and those of one tree at least
        ``least``, which are as many vectors, since a tree holds each once. held: trees x leaves."""
        margins = self.planes @ vector - self.cuts
        queue = [(-np.inf, tree, 0) for tree in range(len(self.planes))]
        found, seen = [], np.zeros(len(self.planes), np.int64)
        while queue and (seen.sum() < enough or seen.max() < least):
            miss, tree, node = heapq.heappop(queue)
            if node >= self.inner:
                leaf = node - self.inner
                if held[tree, leaf]:
                    found.append((tree, leaf))
                    seen[tree] += held[tree, leaf]
                continue
            margin = margins[tree, node]
            # the priority of a way is its smallest margin; the heap gives the smallest miss first
            heapq.heappush(queue, (max(miss, margin), tree, 2 * node + 1))
            heapq.heappush(queue, (max(miss, -margin), tree, 2 * node + 2))
        return found


def _routed(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of any lengths as rows of ``width`` components, for the way through the trees."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        own = unit(matrix(column.take(pa.array(rows))))[:, :width]
        out[rows, : own.shape[1]] = own
    return out


def _entries(classes: DataFrame, forest) -> DataFrame:
    """Tree and leaf of every vector, for every tree."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = forest.value
            leaves = own.leaves(_routed(batch.column("embedding"), own.planes.shape[2]))
            trees = leaves.shape[1]
            rows = np.repeat(np.arange(len(leaves)), trees)
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns,
                    pa.array(np.tile(np.arange(trees, dtype=np.int32), len(leaves))),
                    pa.array(leaves.ravel().astype(np.int32)),
                ],
                names=[*batch.schema.names, "tree", "leaf"],
            )

    schema = T.StructType(
        [*classes.schema.fields, T.StructField("tree", T.IntegerType()), T.StructField("leaf", T.IntegerType())]
    )
    return classes.mapInArrow(run, schema)


def _visited(queries: DataFrame, forest, held: dict[int, np.ndarray], probe: float, k: int) -> DataFrame:
    """held: by length of the vectors, the entries of each tree and leaf."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = forest.value
            vectors = _routed(batch.column("embedding"), own.planes.shape[2])
            rows, trees, leaves = [], [], []
            for row, (vector, size) in enumerate(zip(vectors, batch.column("size").to_pylist())):
                entries = held[size]
                for tree, leaf in own.visits(vector, entries, probe * entries.sum(), k + 1):
                    rows.append(row)
                    trees.append(tree)
                    leaves.append(leaf)
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(trees, pa.int32()), pa.array(leaves, pa.int32())],
                names=[*batch.schema.names, "tree", "leaf"],
            )

    schema = T.StructType(
        [*queries.schema.fields, T.StructField("tree", T.IntegerType()), T.StructField("leaf", T.IntegerType())]
    )
    return queries.mapInArrow(run, schema)


def _ranked(k: int):
    """For mapInArrow: the best candidates of a block for each query of a chunk."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                asked = unit(np.array([q["embedding"] for q in row["queries"]], float))
                held = unit(np.array([v["embedding"] for v in row["vectors"]], float))
                scores = asked @ held.T
                n = min(k + 1, scores.shape[1])  # one more, as the query's own vector may be there
                least = np.partition(scores, -n, axis=1)[:, -n]
                # a product rounds by the shape of its blocks: a little more is taken, and scored pair by pair
                places_q, places_v = np.nonzero(scores >= least[:, None] - 1e-12)
                exact = (asked[places_q] * held[places_v]).sum(axis=1)
                for q, v, score in zip(places_q, places_v, exact.tolist()):
                    out.append((row["queries"][q]["query_id"], row["queries"][q]["node"],
                                row["vectors"][v]["node"], row["vectors"][v]["ids"], score))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.string()),
                    pa.array([o[2] for o in out], pa.string()),
                    pa.array([o[3] for o in out], pa.list_(pa.int64())),
                    pa.array([o[4] for o in out], pa.float64()),
                ],
                names=["query_id", "query_node", "node", "ids", "score"],
            )

    return run


def _chunked(rows: DataFrame, keys: list[str], size: int, name: str, columns: list[str], out: str) -> DataFrame:
    """Rows of each key in chunks of about ``size``, each a list."""
    chunks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("chunks"))
    return (
        rows.join(chunks, keys)
        .withColumn(name, F.pmod(F.xxhash64(*columns[:2]), F.col("chunks")))
        .groupBy(*keys, name)
        .agg(F.collect_list(F.struct(*columns)).alias(out))
    )


def nearest(
    rows: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", probe: float = PROBE
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row where ``is_query`` holds."""
    spark = rows.sparkSession
    steps = Steps(spark)
    named = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), is_query.alias("asks")
    ).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    keyed = steps.keep(named.withColumn("node", content_key(written_out(F.col("embedding")))), "ann_rows")
    # Spark takes the first rows of a window before it shuffles, so copies do not meet in one task
    first = Window.partitionBy("node").orderBy("vec_id")
    classes = steps.keep(
        keyed.select("node", "vec_id", "embedding")
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k + 1)
        .groupBy("node")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.any_value("embedding").alias("embedding")),
        "ann_classes",
    )
    sample = [
        r.embedding
        for r in classes.orderBy(F.xxhash64("node"), "node").limit(FIT_VECTORS).select("embedding").collect()
    ]
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    width = max(len(v) for v in sample)
    fitted = _routed(pa.array(sample, pa.list_(pa.float64())), width)
    forest = spark.sparkContext.broadcast(Forest(fitted))
    size = F.size("embedding").alias("size")
    entries = steps.keep(_entries(classes.select("*", size), forest), "ann_entries")
    held: dict[int, np.ndarray] = {}
    # at most TREES * 2**DEPTH rows for each length
    for r in entries.groupBy("size", "tree", "leaf").count().collect():
        held.setdefault(r["size"], np.zeros((TREES, 2**DEPTH), np.int64))[r["tree"], r["leaf"]] = r["count"]
    queries = keyed.filter("asks").select(F.col("vec_id").alias("query_id"), "node", "embedding", size)
    visits = steps.keep(_visited(queries, forest, held, probe, k), "ann_visits")
    leaf = ["size", "tree", "leaf"]
    blocks = _chunked(entries, leaf, LEAF_ROWS, "block", ["node", "ids", "embedding"], "vectors")
    asked = _chunked(visits, leaf, QUERY_ROWS, "chunk", ["query_id", "node", "embedding"], "queries")
    found = (
        asked.join(blocks, leaf)
        .select("queries", "vectors")
        .mapInArrow(
            _ranked(k), "query_id long, query_node string, node string, ids array<long>, score double"
        )
        .groupBy("query_id", "query_node", "node")
        .agg(F.max("score").alias("score"), F.any_value("ids").alias("ids"))
        .select("query_id", "query_node", "score", F.explode("ids").alias("vec_id"))
        .filter("vec_id <> query_id")
    )
    order = Window.partitionBy("query_id", "query_node").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

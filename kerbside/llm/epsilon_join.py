"""Near-duplicate embeddings by an epsilon grid order join.

Cosine at least c is a distance of at most eps = sqrt(2 - 2c) between vectors of length one. The
vectors are turned into principal directions (an orthonormal basis, so distances stay; it is
fitted on at most ``FIT_VECTORS`` vectors, and only the speed depends on it), cut into grid cells
of side eps along the leading ones, and sorted by cell. The sorted sequence is cut into blocks of
``BLOCK`` vectors; blocks, runs of blocks, partitions and runs of partitions form intervals, each
with its bounding box. The join goes down this hierarchy: pairs of intervals whose boxes lie more
than eps apart are skipped with all they hold, and the remaining pairs of blocks are compared
exactly, in double precision on whole vectors.

Equal vectors of one label are joined as one. A pair of blocks gives counts of links and a
spanning set of edges, never its pairs, so a dense group costs no more rows than it has members.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a
label, link with nothing; so do vectors of different lengths. Rows that repeat a vec_id count as
different vectors; a component's id is its smallest vec_id that is not null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import Steps
from kerbside.llm.components import connected_components
from kerbside.llm.vectors import content_key, matrix, unit, usable, written_out

COSINE = 0.93
FIT_VECTORS = 2_048
GRID_DIMENSIONS = 3
BOX_DIMENSIONS = 8
BLOCK = 256
RUN = 8
PARTITION_RUN = 16


def principal_basis(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length in the sample: orthonormal directions, the widest first."""
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(FIT_VECTORS).select("embedding").collect()
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row.embedding), []).append(row.embedding)
    basis = {}
    for length, rows in by_length.items():
        x = unit(np.array(rows, float))
        basis[length] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return basis


def _turned(rows: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    turned = unit(rows)
    if rows.shape[1] in basis:
        turned = turned @ basis[rows.shape[1]]
    room = max(0, BOX_DIMENSIONS - turned.shape[1])
    return np.pad(turned, ((0, 0), (0, room)))[:, :BOX_DIMENSIONS]


_CELLS = [f"cell{k}" for k in range(GRID_DIMENSIONS)]
_LOW = [f"lo{k}" for k in range(BOX_DIMENSIONS)]
_HIGH = [f"hi{k}" for k in range(BOX_DIMENSIONS)]


def _by_length(batch: pa.RecordBatch, column: str):
    lengths = np.array([len(v) for v in batch.column(column)], dtype=int)
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def _with_cells(classes: DataFrame, basis: dict, eps: float) -> DataFrame:
    schema = T.StructType([*classes.schema.fields, *(T.StructField(c, T.LongType()) for c in _CELLS)])

    def run(batches):
        for batch in batches:
            for _, rows in _by_length(batch, "embedding"):
                part = batch.take(pa.array(rows))
                turned = _turned(matrix(part.column("embedding")), basis)
                cells = np.floor(turned[:, :GRID_DIMENSIONS] / eps).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(cells[:, k]) for k in range(GRID_DIMENSIONS))],
                    names=schema.names,
                )

    return classes.mapInArrow(run, schema)


def _in_blocks(ordered: DataFrame, basis: dict) -> DataFrame:
    """Consecutive rows of one kind (label and length) as one row with its matrix and box."""

    def packed(kind, rows, counter, partition):
        vectors = np.array([r["embedding"] for r in rows], float)
        turned = _turned(vectors, basis)
        return {
            "kind": kind,
            "id": (partition << 32) + counter,
            "nodes": [r["node"] for r in rows],
            "copies": [r["copies"] for r in rows],
            "vectors": unit(vectors).tobytes(),
            **dict(zip(_LOW, turned.min(axis=0).tolist())),
            **dict(zip(_HIGH, turned.max(axis=0).tolist())),
        }

    schema = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("id", T.LongType()),
            T.StructField("nodes", T.ArrayType(T.StringType())),
            T.StructField("copies", T.ArrayType(T.LongType())),
            T.StructField("vectors", T.BinaryType()),
            *(T.StructField(c, T.DoubleType()) for c in _LOW + _HIGH),
        ]
    )
    arrow = pa.schema(
        [
            ("kind", pa.string()),
            ("id", pa.int64()),
            ("nodes", pa.list_(pa.string())),
            ("copies", pa.list_(pa.int64())),
            ("vectors", pa.binary()),
            *((c, pa.float64()) for c in _LOW + _HIGH),
        ]
    )

    def run(batches):
        from pyspark import TaskContext

        partition, counter, kind, held = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            blocks = []
            for row in batch.to_pylist():
                if held and (row["kind"] != kind or len(held) == BLOCK):
                    blocks.append(packed(kind, held, counter, partition))
                    counter, held = counter + 1, []
                kind = row["kind"]
                held.append(row)
            if blocks:
                yield pa.RecordBatch.from_pylist(blocks, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([packed(kind, held, counter, partition)], schema=arrow)

    return ordered.select("kind", "node", "copies", "embedding").mapInArrow(run, schema)


def _near(eps: float):
    gap = F.lit(0.0)
    for low, high in zip(_LOW, _HIGH):
        apart = F.greatest(
            F.col(f"a_{low}") - F.col(f"b_{high}"), F.col(f"b_{low}") - F.col(f"a_{high}"), F.lit(0.0)
        )
        gap = gap + apart * apart
    return gap <= eps * eps * (1 + 1e-9)


def _side(level: DataFrame, side: str) -> DataFrame:
    return level.select(*(F.col(c).alias(c if c == "kind" else f"{side}_{c}") for c in level.columns))


def near_block_pairs(blocks: DataFrame, eps: float, steps: Steps) -> DataFrame:
    """a, b: ids of the pairs of blocks that may hold vectors within eps; a <= b."""
    boxes = [F.min(c).alias(c) for c in _LOW] + [F.max(c).alias(c) for c in _HIGH]
    low, high = F.col("id").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("id", 32)
    up = [
        F.col("id") - low % RUN,
        F.shiftleft(high, 32),
        F.shiftleft(high - high % PARTITION_RUN, 32),
    ]
    levels = [blocks.select("kind", "id", *_LOW, *_HIGH)]
    for parent in up:  # from blocks up to runs of partitions
        below = levels[-1].withColumn("parent", parent)
        levels[-1] = below
        levels.append(below.groupBy("kind", F.col("parent").alias("id")).agg(*boxes))
    top = levels.pop()
    a, b = _side(top, "a"), _side(top, "b")
    pairs = a.join(b, "kind").filter((F.col("a_id") <= F.col("b_id")) & _near(eps)).select("kind", "a_id", "b_id")
    for place, level in enumerate(reversed(levels)):
        a = _side(level, "a")
        b = _side(level, "b")
        above = pairs.select("kind", F.col("a_id").alias("a_parent"), F.col("b_id").alias("b_parent"))
        pairs = steps.keep(
            above.join(a, ["kind", "a_parent"])
            .join(b, ["kind", "b_parent"])
            .filter((F.col("a_id") <= F.col("b_id")) & _near(eps))
            .select("kind", "a_id", "b_id"),
            f"ego_pairs_{place}",
        )
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _compared(cosine: float):
    """For mapInArrow: per pair of blocks, links counted per vector, and spanning edges."""

    def spanning(linked: np.ndarray) -> np.ndarray:
        """For each row and column the smallest row reachable (a row without links: itself)."""
        rows = np.arange(linked.shape[0])
        while True:
            columns = np.where(linked, rows[:, None], len(rows)).min(axis=0)
            new = np.minimum(rows, np.where(linked, columns[None, :], len(rows)).min(axis=1))
            if (new == rows).all():
                return rows, columns
            rows = new

    def run(batches):
        for batch in batches:
            nodes, links, edge_a, edge_b = [], [], [], []
            for row in batch.to_pylist():
                names_a, names_b = row["a_nodes"], row["b_nodes"]
                a = np.frombuffer(row["a_vectors"]).reshape(len(names_a), -1)
                b = np.frombuffer(row["b_vectors"]).reshape(len(names_b), -1)
                linked = a @ b.T >= cosine
                same = row["a"] == row["b"]
                if same:
                    np.fill_diagonal(linked, False)
                for names, counts in (
                    (names_a, linked @ np.array(row["b_copies"])),
                    (names_b, [] if same else np.array(row["a_copies"]) @ linked),
                ):
                    for name, count in zip(names, counts):
                        if count:
                            nodes.append(name)
                            links.append(int(count))
                rows, columns = spanning(linked)
                for i, root in enumerate(rows):
                    if root != i:
                        edge_a.append(names_a[root])
                        edge_b.append(names_a[i])
                for j, root in enumerate(columns):
                    if root < len(rows) and names_a[root] != names_b[j]:
                        edge_a.append(names_a[root])
                        edge_b.append(names_b[j])
            filled = [None] * len(edge_a)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes + filled, pa.string()),
                    pa.array(links + filled, pa.int64()),
                    pa.array([None] * len(nodes) + edge_a, pa.string()),
                    pa.array([None] * len(nodes) + edge_b, pa.string()),
                ],
                names=["node", "links", "a", "b"],
            )

    return run


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = rows.sparkSession
    steps = Steps(spark)
    eps = float(np.sqrt(2 - 2 * cosine))
    named = rows.select(
        F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("embedding")
    )
    joins = usable(F.col("embedding")) & F.col("label").isNotNull()
    keyed = steps.keep(
        named.withColumn("node", F.when(joins, content_key(F.col("label"), written_out(F.col("embedding"))))),
        "ego_rows",
    )
    some = keyed.filter(F.col("node").isNotNull())
    classes = steps.keep(
        some.groupBy("node").agg(
            F.min("vec_id").alias("first_id"),
            F.count(F.lit(1)).alias("copies"),
            F.any_value("embedding").alias("embedding"),
            F.concat_ws(":", F.any_value("label"), F.size(F.any_value("embedding"))).alias("kind"),
        ),
        "ego_classes",
    )
    basis = principal_basis(classes)
    placed = _with_cells(classes, basis, eps)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["kind", *_CELLS, "node"]
    blocks = steps.keep(
        _in_blocks(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order), basis), "ego_blocks"
    )
    pairs = near_block_pairs(blocks, eps, steps)
    held = blocks.select("id", "nodes", "copies", "vectors")
    full = pairs.join(held.toDF("a", "a_nodes", "a_copies", "a_vectors"), "a").join(
        held.toDF("b", "b_nodes", "b_copies", "b_vectors"), "b"
    )
    found = steps.keep(
        full.mapInArrow(_compared(cosine), "node string, links long, a string, b string"), "ego_found"
    )
    counts = found.filter("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.filter("a is not null").select("a", "b"), steps, "ego_components")
    every = (
        classes.select("node", "first_id", "copies")
        .join(counts, "node", "left")
        .join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = every.groupBy("component").agg(F.min("first_id").alias("component_id"))
    final = steps.keep(
        every.join(least, "component").select(
            "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
        ),
        "ego_final",
    )
    linked = some.select("vec_id", "node").join(final, "node").select("vec_id", "n_links", "component_id")
    alone = keyed.filter(F.col("node").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

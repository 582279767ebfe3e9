"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions (a binary tree of 255 nodes), and every decision node has a
tree of byte contexts of depth 0 to ``DEPTH``. At each context the Krichevsky-Trofimov estimate of
its counts is weighted, half and half, with the product of its children; the weights after
training mix the estimates of all depths into the chance of the next bit. Summed up that is the
code length of a text, given as log10 of its probability. Texts are scored in lower case (A-Z
only) with one end mark; before a text lie ``DEPTH`` end marks as context.

Every context seen at least ``LEAST`` times becomes a node of its own, so the tree grows with the
corpus; contexts seen less often form one further child of their node, so the children always split
the node's counts.

1. Texts are written in chunks of about ``CHUNK`` bytes. One pass yields, for each chunk, its
   different codes (the ``DEPTH`` bytes before a place, nearest first, and the byte there) with
   their training counts; a groupBy sums them up to the counts of the corpus.
2. Codes that share the nearest three bytes are one subtree. They meet in one task, sorted, which
   weighs their contexts from depth ``DEPTH`` up to 3; what the contexts of three bytes add to those
   of two is summed up in Spark. Depths 0 to 2 have at most 65,793 contexts, whatever the corpus, and
   are weighed on the driver.
3. With the weights of depths 0 to 2 sent to the tasks, each subtree is weighed again and gives the
   chance of every code that occurs in any text.
4. The codes of each chunk are joined with these chances and meet the texts of the chunk, whose
   places look them up.

For the unigram base, words are counted over the whole training part; words above ``COMMON_SHARE``
(at most 1 / COMMON_SHARE of them) are looked up in the workers, all others meet their counts in a
join. ``train`` gives the same model as arrays on the driver, for small corpora only.

Null texts read as empty: one end token, and the chance of an end after nothing. Without training
documents every bit has an even chance and every count is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import Steps, remainder, text_column
from kerbside.llm.text_hashes import BLOCK, _LOWER, text_bytes, word_hashes

HOLD_OUT = (7, 2)
DEPTH = 6
LEAST = 2
CHUNK = 1 << 26
SUBTREE = 3  # nearest bytes that the codes of a subtree share
GROUP = 300_000
COMMON_SHARE = 2.0**-20
END = 255  # no byte of UTF-8
END_TOKEN = np.uint64(0x5EED0FE4D0FDEAD1)


def byte_runs(column: pa.Array):
    """(first row, end row, stream, predicted, starts) for runs of rows.

    A stream holds the lowered bytes of some rows, with ``DEPTH`` end marks before each and after
    the last. ``predicted`` flags its places from ``DEPTH`` on: the bytes, and the end mark of each
    row. ``starts`` are the places among these where each row begins. A long text comes in several
    streams, each led by the bytes before it.
    """
    data, offsets = text_bytes(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1, first + 1)
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= BLOCK:
            starts = offsets[first:last] - begin + (DEPTH + 1) * np.arange(last - first)
            ends = starts + np.diff(offsets[first : last + 1])
            is_byte = np.ones(end - begin + (DEPTH + 1) * (last - first), bool)
            for k in range(DEPTH + 1):
                is_byte[ends + k] = False
            stream = np.full(DEPTH + len(is_byte), END, np.uint8)
            stream[DEPTH:][is_byte] = _LOWER[data[begin:end]]
            is_byte[ends] = True
            yield first, last, stream, is_byte, starts
        else:
            text = _LOWER[data[begin:end]]
            for at in range(0, len(text), BLOCK):
                lead = text[max(0, at - DEPTH) : at]
                marks = np.full(DEPTH - len(lead), END, np.uint8)
                tail = np.full(1 if at + BLOCK >= len(text) else 0, END, np.uint8)
                stream = np.concatenate([marks, lead, text[at : at + BLOCK], tail])
                yield first, last, stream, np.ones(len(stream) - DEPTH, bool), np.zeros(1, np.int64)
        first = last


@dataclass
class Tree:
    """Contexts by depth. ``children[d][node, byte]`` is the node of depth d + 1 that the byte before
    a context of depth d leads to; one more row and one number above the last stand for "none"."""

    children: list[np.ndarray]
    sizes: list[int]  # nodes at each depth

    def grow(self, contexts: np.ndarray, least: float) -> np.ndarray:
        """Add a depth: contexts (nodes x byte before) with enough counts. Returns which those are."""
        enough = contexts >= least
        n = int(enough.sum())
        children = np.full((len(contexts) + 1, 256), n, np.int32)
        children[:-1][enough] = np.arange(n)
        self.children.append(children)
        self.sizes.append(n)
        return enough

    def edges(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Node and byte of every child of that depth's nodes, in the order of the children."""
        return np.nonzero(self.children[depth][:-1] < self.sizes[depth + 1])

    def walk(self, stream: np.ndarray, depth: int) -> list[np.ndarray]:
        """Nodes of each place from ``DEPTH`` on, at depths 0 to ``depth``."""
        node = np.zeros(len(stream) - DEPTH, np.int32)
        path = [node]
        for d in range(depth):
            before = stream[DEPTH - d - 1 : len(stream) - d - 1]
            place = node * np.int32(256)
            place += before
            node = self.children[d].ravel().take(place)
            path.append(node)
        return path


_COUNTED = "code int, n long"


def _added(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n)], names=["code", "n"])


def _summed(docs: DataFrame, run) -> DataFrame:
    return docs.select("text").mapInArrow(run, _COUNTED).groupBy("code").agg(F.sum("n").alias("n"))


def _trigrams(docs: DataFrame) -> DataFrame:
    """code, n: counts of three bytes in a row, the last of them a predicted one."""

    def run(batches):
        held = np.zeros(1 << 24, np.uint32)  # below 2**32 places in one task
        for batch in batches:
            for _, _, stream, predicted, _ in byte_runs(text_column(batch)):
                code = stream[DEPTH - 2 : -2].astype(np.int32) << 16
                code |= stream[DEPTH - 1 : -1].astype(np.int32) << 8
                code |= stream[DEPTH:]
                found, n = np.unique(code[predicted], return_counts=True)
                held[found] += n.astype(np.uint32)
        found = np.flatnonzero(held)
        for begin in range(0, len(found), 100_000):
            part = found[begin : begin + 100_000]
            yield _added(part, held[part].astype(np.int64))

    return _summed(docs, run)


def _around(docs: DataFrame, tree, depth: int) -> DataFrame:
    """code, n: counts of node of that depth * 256 + next byte, and, for depths that may grow, of
    (nodes + node) * 256 + the byte before the context."""

    def run(batches):
        own = tree.value
        size = (own.sizes[depth] + 1) * 256  # with the places that lead to no node
        after, before = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for _, _, stream, predicted, _ in byte_runs(text_column(batch)):
                place = own.walk(stream, depth)[-1] * np.int32(256)
                place = place[predicted]
                after += np.bincount(place + stream[DEPTH:][predicted], minlength=size)
                if depth < DEPTH:
                    older = stream[DEPTH - depth - 1 : len(stream) - depth - 1]
                    before += np.bincount(place + older[predicted], minlength=size)
        every = np.concatenate([after[:-256], before[:-256]])
        found = np.flatnonzero(every)
        yield _added(found, every[found])

    return _summed(docs, run)


def _dense(counts: DataFrame, size: int) -> np.ndarray:
    rows = counts.toArrow()  # at most ``size`` numbers, which the model's bounds fix
    out = np.zeros(size)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for positive numbers."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _decisions(next_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (0, 1) at each of the 256 decision nodes (place 0 is unused)."""
    totals = np.zeros((len(next_bytes), 512))
    totals[:, 256:] = next_bytes
    for node in range(255, 0, -1):
        totals[:, node] = totals[:, 2 * node] + totals[:, 2 * node + 1]
    zeros, ones = np.zeros((2, len(next_bytes), 256))
    inner = np.arange(1, 256)
    zeros[:, 1:], ones[:, 1:] = totals[:, 2 * inner], totals[:, 2 * inner + 1]
    return zeros, ones


def _block_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of all counted bits."""
    half = _log_gamma(np.array([0.5]))[0]
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - 2 * half


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Chance of a one."""
    return (ones + 0.5) / (zeros + ones + 1)


def _byte_logs(one: np.ndarray) -> np.ndarray:
    """log10 of the chance of each byte, from the chance of a one at each decision node."""
    one = np.clip(one, 1e-12, 1 - 1e-12)
    chance = np.zeros((len(one), 512))
    for node in range(1, 256):
        chance[:, 2 * node] = chance[:, node] + np.log10(1 - one[:, node])
        chance[:, 2 * node + 1] = chance[:, node] + np.log10(one[:, node])
    return chance[:, 256:]


@dataclass
class Model:
    """``log10[d][node, byte]``: chance of a byte where the deepest node of its context is this."""

    tree: Tree
    log10: list[np.ndarray]

    def places(self, stream: np.ndarray) -> np.ndarray:
        """log10 of the chance of each byte from ``DEPTH`` on."""
        byte = stream[DEPTH:]
        out = self.log10[0][0].take(byte)
        for depth, node in enumerate(self.tree.walk(stream, DEPTH)[1:], 1):
            held = np.flatnonzero(node < self.tree.sizes[depth])
            out[held] = self.log10[depth].ravel().take(node[held] * np.int32(256) + byte[held])
        return out


def _rest(tree: Tree, counts: list[np.ndarray], depth: int) -> np.ndarray:
    """Counts of the places that lead to no child of their own."""
    rest = counts[depth].copy()
    node, _ = tree.edges(depth)
    if len(node):
        heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        rest[node[heads]] -= np.add.reduceat(counts[depth + 1], heads, axis=0)
    return np.maximum(rest, 0)


def _some(n: int) -> list[slice]:
    """Nodes in runs, so that working arrays stay small beside the counts."""
    return [slice(i, min(i + 1_024, n)) for i in range(0, n, 1_024)]


def weighted(tree: Tree, counts: list[np.ndarray]) -> Model:
    """The mixture over all depths. counts[d]: nodes of depth d x next byte."""
    stays: list = [None] * (DEPTH + 1)  # chance that the node's own estimate is the model
    total = np.zeros((len(counts[DEPTH]), 256))
    for run in _some(len(total)):
        total[run] = _block_estimate(*_decisions(counts[DEPTH][run]))
    for depth in range(DEPTH - 1, -1, -1):
        rest = _rest(tree, counts, depth)
        below = np.zeros((len(rest), 256))
        for run in _some(len(rest)):
            below[run] = _block_estimate(*_decisions(rest[run]))
        np.add.at(below, tree.edges(depth)[0], total)
        stays[depth] = np.zeros((len(rest), 256), np.float32)
        total = below
        for run in _some(len(rest)):
            own = _block_estimate(*_decisions(counts[depth][run])) + np.log(0.5)
            total[run] = np.logaddexp(own, below[run] + np.log(0.5))
            stays[depth][run] = np.exp(own - total[run])
    del total, below
    log10, mixed, left = [], np.zeros((1, 256), np.float32), np.ones((1, 256), np.float32)
    for depth in range(DEPTH + 1):
        n = len(counts[depth])
        table = np.zeros((n, 256), np.float32)
        rest = _rest(tree, counts, depth) if depth < DEPTH else None
        for run in _some(n):
            own = _estimate(*_decisions(counts[depth][run]))
            one = mixed[run] + left[run] * own
            if depth < DEPTH:
                mixed[run] += left[run] * stays[depth][run] * own
                left[run] *= 1 - stays[depth][run]
                one = mixed[run] + left[run] * _estimate(*_decisions(rest[run]))
            table[run] = _byte_logs(one)
        log10.append(table)
        if depth < DEPTH:
            node = tree.edges(depth)[0]
            mixed, left = mixed[node], left[node]
            counts[depth] = counts[depth][:0]  # not needed below
    return Model(tree, log10)


def train(docs: DataFrame) -> Model:
    """Counts over all texts of ``docs`` (its column ``text``), and the weighted model as arrays.

    All nodes go to the driver: it is for small corpora, and ``score_documents`` does without it.
    """
    spark = docs.sparkSession
    three = _dense(_trigrams(docs), 1 << 24).reshape(256, 256, 256)  # byte before, before, next
    two = three.sum(axis=0)
    tree = Tree([], [1])
    counts = [two.sum(axis=0)[None, :]]
    ones = np.flatnonzero(tree.grow(two.sum(axis=1)[None, :], LEAST)[0])
    counts.append(two[ones])
    # contexts of two bytes: rows are nodes of depth 1, columns the byte before
    node, before = np.nonzero(tree.grow(three.sum(axis=2).T[ones], LEAST))
    counts.append(three[before, ones[node]])
    # contexts of three bytes are counted as three bytes in a row
    tree.grow(three[:, before, ones[node]].T, LEAST)
    del three
    for depth in range(3, DEPTH + 1):
        n = tree.sizes[depth]
        shared = spark.sparkContext.broadcast(tree)
        both = _dense(_around(docs, shared, depth), 2 * n * 256).reshape(2, n, 256)
        counts.append(both[0].copy())
        if depth < DEPTH:
            tree = Tree([*tree.children], [*tree.sizes])
            tree.grow(both[1], LEAST)
        del both
        shared.unpersist()
    return weighted(tree, counts)


def codes_of(stream: np.ndarray) -> np.ndarray:
    """The bytes before each place from ``DEPTH`` on, nearest first, and the byte there, as a number."""
    code = np.zeros(len(stream) - DEPTH, np.int64)
    for k in range(1, DEPTH + 1):
        code = (code << 8) | stream[DEPTH - k : len(stream) - k]
    return (code << 8) | stream[DEPTH:]


def _heads(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def _sums(n: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n, heads) if len(heads) else n[:0]


def _held(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``known``, and whether the value is there."""
    if not len(known):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    place = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return place, known[place] == x


_FEW = np.arange(4_096)
_HALVES, _WHOLES = _log_gamma(_FEW + 0.5), _log_gamma(_FEW + 1.0)


def _counted_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``_block_estimate`` of whole numbers, most of them small."""

    def looked_up(table, n, shift):
        out = table[np.minimum(n, len(table) - 1)]
        large = n >= len(table)
        if large.any():
            out[large] = _log_gamma(n[large] + shift)
        return out

    both = looked_up(_HALVES, zeros, 0.5) + looked_up(_HALVES, ones, 0.5)
    return both - looked_up(_WHOLES, zeros + ones, 1.0) - 2 * _HALVES[0]


@dataclass
class Level:
    """Decision nodes of the contexts of one depth whose byte so far has the same number of bits.

    ``keys`` are sorted: the context, then these bits. ``rest`` counts what leads to no node."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    rest_zeros: np.ndarray
    rest_ones: np.ndarray
    stays: np.ndarray  # chance that the node's own estimate is the model
    total: np.ndarray


def subtrees(codes: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, list[Level]]]:
    """Nodes and weights at depths ``SUBTREE`` to ``DEPTH``; ``codes`` are sorted, without repeats."""
    out: dict[int, tuple[np.ndarray, list[Level]]] = {}
    for depth in range(DEPTH, SUBTREE - 1, -1):
        if depth < DEPTH:  # without the farthest byte
            codes, group = np.unique(((codes >> 16) << 8) | (codes & 255), return_inverse=True)
            n = np.bincount(group, n, len(codes)).astype(np.int64)
        heads = _heads(codes >> 8)
        enough = _sums(n, heads) >= LEAST
        keep = np.repeat(enough, np.diff(np.append(heads, len(codes))))
        own_codes, own_n = codes[keep], n[keep]
        levels = []
        for bits in range(8):
            key = own_codes >> (8 - bits)
            begins = _heads(key)
            key = key[begins]
            ones = _sums(own_n * ((own_codes >> (7 - bits)) & 1), begins)
            zeros = _sums(own_n, begins) - ones
            own = _counted_estimate(zeros, ones)
            if depth == DEPTH:
                none = np.zeros(len(key), np.int64)
                levels.append(Level(key, zeros, ones, none, none, np.ones(len(key)), own))
                continue
            child = out[depth + 1][1][bits]
            at = np.searchsorted(key, (child.keys >> (bits + 8) << bits) | (child.keys & ((1 << bits) - 1)))
            rest_zeros = zeros - np.bincount(at, child.zeros, len(key)).astype(np.int64)
            rest_ones = ones - np.bincount(at, child.ones, len(key)).astype(np.int64)
            own += np.log(0.5)
            below = _counted_estimate(rest_zeros, rest_ones) + np.bincount(at, child.total, len(key))
            total = np.logaddexp(own, below + np.log(0.5))
            levels.append(Level(key, zeros, ones, rest_zeros, rest_ones, np.exp(own - total), total))
        out[depth] = ((codes >> 8)[heads][enough], levels)
    return out


@dataclass
class Top:
    """Depths 0 to 2. ``ids``: contexts by depth; ``tables``: log10 of the chance of each byte where the
    deepest node is this; ``mixed`` and ``left``: at the contexts of two bytes, what depths 0 to 2 add
    to the chance of a one, and the weight of the depths below."""

    ids: list[np.ndarray]
    tables: list[np.ndarray]
    mixed: np.ndarray
    left: np.ndarray


def top_of(pairs: pa.Table, below: pa.Table) -> Top:
    """From the counts of (context of two bytes, byte), and the sums over contexts of three bytes."""
    code, n = pairs.column("code").to_numpy(), pairs.column("n").to_numpy()
    every, row = np.unique(code >> 8, return_inverse=True)
    counts = [np.zeros((1, 256)), np.zeros((256, 256)), np.zeros((len(every), 256))]
    np.add.at(counts[2], (row, code & 255), n)
    np.add.at(counts[1], every >> 8, counts[2])
    counts[0][0] = counts[1].sum(axis=0)
    ids = [np.zeros(1, np.int64), np.arange(256), every]
    for depth in (1, 2):
        enough = counts[depth].sum(axis=1) >= LEAST
        ids[depth], counts[depth] = ids[depth][enough], counts[depth][enough]
    above = [None, np.zeros(len(ids[1]), np.int64), np.searchsorted(ids[1], ids[2] >> 8)]

    key = below.column("key").to_numpy()
    place = (np.searchsorted(ids[2], key >> 8), key & 255)
    child = {}
    for name in ("total", "zeros", "ones"):
        child[name] = np.zeros((len(ids[2]), 256))
        child[name][place] = below.column(name).to_numpy()
    child["total"] /= FIXED
    stays, rests = [None] * 3, [None] * 3
    for depth in (2, 1, 0):
        zeros, ones = _decisions(counts[depth])
        rest = (zeros - child["zeros"], ones - child["ones"])
        own = _block_estimate(zeros, ones) + np.log(0.5)
        total = np.logaddexp(own, _block_estimate(*rest) + child["total"] + np.log(0.5))
        stays[depth], rests[depth] = np.exp(own - total), rest
        if depth:
            child = {}
            for name, values in (("total", total), ("zeros", zeros), ("ones", ones)):
                child[name] = np.zeros((len(ids[depth - 1]), 256))
                np.add.at(child[name], above[depth], values)
    tables, mixed, left = [], np.zeros((1, 256)), np.ones((1, 256))
    for depth in range(3):
        if depth:
            mixed, left = mixed[above[depth]], left[above[depth]]
        mixed = mixed + left * stays[depth] * _estimate(*_decisions(counts[depth]))
        left = left * (1 - stays[depth])
        tables.append(_byte_logs(mixed + left * _estimate(*rests[depth])).astype(np.float32))
    return Top(ids, tables, mixed.astype(np.float32), left.astype(np.float32))


def chances(codes: np.ndarray, depths: dict[int, tuple[np.ndarray, list[Level]]], top: Top) -> np.ndarray:
    """log10 of the chance of the byte of each code after its context."""
    byte = codes & 255
    out = top.tables[0][0][byte].astype(np.float64)
    for depth in (1, 2):
        place, known = _held(top.ids[depth], codes >> (8 * (DEPTH + 1 - depth)))
        out[known] = top.tables[depth][place[known], byte[known]]
    known &= _held(depths[SUBTREE][0], codes >> (8 * (DEPTH + 1 - SUBTREE)))[1]
    inner, two = codes[known], place[known]
    deepest = np.full(len(inner), SUBTREE)
    for depth in range(SUBTREE + 1, DEPTH + 1):
        deepest[_held(depths[depth][0], inner >> (8 * (DEPTH + 1 - depth)))[1]] = depth
    logs = np.zeros(len(inner))
    for bits in range(8):
        so_far = (inner & 255) >> (8 - bits)
        mixed = top.mixed[two, (1 << bits) | so_far].astype(np.float64)
        left = top.left[two, (1 << bits) | so_far].astype(np.float64)
        at = np.arange(len(inner))
        for depth in range(SUBTREE, DEPTH + 1):
            if not len(at):
                break
            level = depths[depth][1][bits]
            place, seen = _held(level.keys, (inner[at] >> (8 * (DEPTH + 1 - depth)) << bits) | so_far[at])
            zeros, ones = np.where(seen, level.zeros[place], 0), np.where(seen, level.ones[place], 0)
            stays = np.where(seen, level.stays[place], 0.5 if depth < DEPTH else 1.0)
            mixed[at] += left[at] * stays * _estimate(zeros, ones)
            left[at] *= 1 - stays
            last = deepest[at] == depth
            rest = _estimate(
                np.where(seen, level.rest_zeros[place], 0)[last], np.where(seen, level.rest_ones[place], 0)[last]
            )
            mixed[at[last]] += left[at[last]] * rest
            at = at[~last]
        one = np.clip(mixed, 1e-12, 1 - 1e-12)
        logs += np.log10(np.where((inner >> (7 - bits)) & 1, one, 1 - one))
    out[known] = logs
    return out


def _chunked(docs: DataFrame) -> DataFrame:
    """All columns, the row's own number, and its chunk: the number of the chunk's first row."""
    schema = T.StructType(
        [*docs.schema, T.StructField("row", T.LongType()), T.StructField("chunk", T.LongType())]
    )

    def run(batches):
        from pyspark import TaskContext

        number = chunk = TaskContext.get().partitionId() << 33
        held = 0
        for batch in batches:
            sizes = np.diff(text_bytes(text_column(batch))[1])
            chunks = np.empty(len(sizes), np.int64)
            for i, size in enumerate(sizes.tolist()):
                if held and held + size > CHUNK:
                    chunk, held = number + i, 0
                chunks[i] = chunk
                held += size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(number + np.arange(len(sizes))), pa.array(chunks)], names=schema.names
            )
            number += len(sizes)

    return docs.mapInArrow(run, schema)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    heads = _heads(codes)
    return codes[heads], _sums(np.concatenate([p[1] for p in parts])[order], heads)


def _chunk_codes(texts: DataFrame) -> DataFrame:
    """chunk, code, n: the different codes of each chunk, and how often its training texts hold them."""

    def run(batches):
        chunk, parts, waiting, settled = None, [], 0, 0

        def rows():
            codes, n = _merged(parts)
            for begin in range(0, len(codes), 100_000):
                part = codes[begin : begin + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(n[begin : begin + 100_000])],
                    names=["chunk", "code", "n"],
                )

        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            cuts = np.append(_heads(chunks), len(chunks))
            for begin, end in zip(cuts[:-1], cuts[1:]):
                if chunks[begin] != chunk:
                    if parts:
                        yield from rows()
                    chunk, parts, waiting, settled = chunks[begin], [], 0, 0
                part = batch.slice(begin, end - begin)
                trains = ~part.column("held_out").to_numpy(zero_copy_only=False)
                for first, last, stream, predicted, starts in byte_runs(text_column(part)):
                    weight = np.repeat(trains[first:last], np.diff(np.append(starts, len(predicted))))
                    marked = (codes_of(stream) << 1) | weight
                    found, n = np.unique(marked[predicted], return_counts=True)
                    parts.append((found >> 1, n * (found & 1)))
                    waiting += len(found)
                    if waiting > 2 * settled + (1 << 21):
                        parts = [_merged(parts)]
                        waiting = settled = len(parts[0][0])
        if parts:
            yield from rows()

    return texts.select("chunk", "held_out", "text").mapInArrow(run, "chunk long, code long, n long")


def _by_subtree(counts: DataFrame) -> DataFrame:
    low = 8 * (DEPTH + 1 - SUBTREE)
    return counts.repartition(F.shiftright("code", low)).sortWithinPartitions("code")


def _whole_subtrees(batches):
    """Codes and counts of whole subtrees, at least ``GROUP`` codes at once but for the last."""
    low, parts, waiting = 8 * (DEPTH + 1 - SUBTREE), [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append((batch.column("code").to_numpy(), batch.column("n").to_numpy()))
        waiting += batch.num_rows
        if waiting < GROUP or parts[0][0][0] >> low == parts[-1][0][-1] >> low:
            continue
        codes, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        cut = int(np.searchsorted(codes >> low, codes[-1] >> low))
        yield codes[:cut], n[:cut]
        parts, waiting = [(codes[cut:], n[cut:])], len(codes) - cut
    if waiting:
        yield tuple(np.concatenate([p[i] for p in parts]) for i in (0, 1))


FIXED = 2.0**20  # totals are summed as whole numbers, so their order does not matter


def _sums_below(counts: DataFrame) -> DataFrame:
    """key (context of two bytes, decision node), and the sums over its contexts of three bytes."""

    def run(batches):
        for codes, n in _whole_subtrees(batches):
            for bits, level in enumerate(subtrees(codes, n)[SUBTREE][1]):
                if not len(level.keys):
                    continue
                so_far = level.keys & ((1 << bits) - 1)
                key, group = np.unique(
                    (level.keys >> (bits + 8) << 8) | (1 << bits) | so_far, return_inverse=True
                )
                sums = [
                    np.bincount(group, values, len(key)).astype(np.int64)
                    for values in (np.rint(level.total * FIXED), level.zeros, level.ones)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), *map(pa.array, sums)], names=["key", "total", "zeros", "ones"]
                )

    rows = _by_subtree(counts).mapInArrow(run, "key long, total long, zeros long, ones long")
    return rows.groupBy("key").agg(*(F.sum(name).alias(name) for name in ("total", "zeros", "ones")))


def _code_chances(counts: DataFrame, top) -> DataFrame:
    """code, log10 of its chance, for all codes of all texts."""

    def run(batches):
        for codes, n in _whole_subtrees(batches):
            trained = n > 0
            logs = chances(codes, subtrees(codes[trained], n[trained]), top.value)
            for begin in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(codes[begin : begin + 100_000]),
                        pa.array(logs[begin : begin + 100_000].astype(np.float32)),
                    ],
                    names=["code", "log10"],
                )

    return _by_subtree(counts).mapInArrow(run, "code long, log10 float")


def _squeezed(values: np.ndarray) -> bytes:
    """Compressed, the first bytes of all values before the second ones: sorted numbers share their high bytes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return planes.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(held: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(held[:8], "little")
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(held[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.frombuffer(planes.reshape(width, size // width).T.tobytes(), kind)


def _packed(chances: DataFrame) -> DataFrame:
    """chunk, codes, logs: the rows of a chunk, sorted by code, in a few long compressed byte strings."""

    def run(batches):
        parts, waiting = [], 0

        def packed():
            chunk, code, log10 = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((code, chunk))
            chunk, code, log10 = chunk[order], code[order], log10[order]
            cuts = np.append(_heads(chunk), len(chunk))
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk[a : a + 1]),
                        pa.array([_squeezed(code[a:b])], pa.binary()),
                        pa.array([_squeezed(log10[a:b])], pa.binary()),
                    ],
                    names=["chunk", "codes", "logs"],
                )

        for batch in batches:
            parts.append([batch.column(name).to_numpy() for name in ("chunk", "code", "log10")])
            waiting += batch.num_rows
            if waiting > 1 << 20:
                yield from packed()
                parts, waiting = [], 0
        if waiting:
            yield from packed()

    return chances.select("chunk", "code", "log10").mapInArrow(run, "chunk long, codes binary, logs binary")


def word_counts(docs: DataFrame) -> DataFrame:
    """word (a 64-bit hash), n: counts over all texts, one end token for each."""

    def run(batches):
        for batch in batches:
            held, waiting = [], 0
            for first, last, words, _ in word_hashes(text_column(batch)):
                held.append(words)
                held.append(np.full(last - first, END_TOKEN, np.uint64))
                waiting += len(words)
                if waiting > 1 << 21:
                    yield _counted(held)
                    held, waiting = [], 0
            if held:
                yield _counted(held)

    def _counted(held):
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"]
        )

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _scored(texts: DataFrame, packed: DataFrame, common) -> DataFrame:
    """Per row: its own number, the model's score, what the common words give, and the others."""

    def run(batches):
        hashes, logs = common.value
        chunk, parts, known_codes, known_logs = None, [], None, None
        for batch in _by_kind(batches):
            if batch.column("row").null_count:
                if batch.column("chunk")[0].as_py() != chunk:
                    chunk, parts = batch.column("chunk")[0].as_py(), []
                for code, log10 in zip(batch.column("codes"), batch.column("logs")):
                    parts.append((_unsqueezed(code.as_py(), np.int64), _unsqueezed(log10.as_py(), np.float32)))
                known_codes = None
                continue
            if known_codes is None:
                known_codes, known_logs = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                order = np.argsort(known_codes, kind="stable")
                known_codes, known_logs = known_codes[order], known_logs[order]
                parts = []
            n = batch.num_rows
            column = text_column(batch)
            score, base = np.zeros(n), np.zeros(n)
            tokens, known, rare = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            for first, last, stream, predicted, starts in byte_runs(column):
                found, place = np.unique(codes_of(stream)[predicted], return_inverse=True)
                logs10 = np.zeros(len(predicted))
                logs10[predicted] = known_logs[np.searchsorted(known_codes, found)][place]
                score[first:last] += np.add.reduceat(logs10, starts)
            for first, last, words, offsets in word_hashes(column):
                sizes = np.diff(offsets)
                row = np.repeat(np.arange(first, last), sizes + 1)
                every = np.insert(words, offsets[1:], END_TOKEN)
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, every), len(hashes) - 1)
                    is_common = hashes[place] == every
                    base += np.bincount(row[is_common], logs[place[is_common]], minlength=n)
                else:
                    is_common = np.zeros(len(every), bool)
                tokens[first:last] = sizes + 1
                known += np.bincount(row[is_common], minlength=n)
                others, owner = every[~is_common], row[~is_common]
                cuts = np.searchsorted(owner, np.arange(first, last + 1))
                for i in range(last - first):
                    rare[first + i] = others[cuts[i] : cuts[i + 1]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    batch.column("row"),
                    pa.array(tokens),
                    pa.array(known),
                    pa.array(base),
                    pa.array(score),
                    pa.array(rare, pa.list_(pa.int64())),
                ],
                names=["doc_id", "held_out", "row", "n_tokens", "common", "base", "score", "rare"],
            )

    kinds = [texts.schema["doc_id"], T.StructField("held_out", T.BooleanType())]
    schema = T.StructType(
        [
            *kinds,
            T.StructField("row", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("common", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rare", T.ArrayType(T.LongType())),
        ]
    )
    columns = ["chunk", "row", "doc_id", "held_out", "text", "codes", "logs"]
    both = texts.unionByName(packed, allowMissingColumns=True).select(*columns)
    # nulls come first: what a chunk looks up lies before its texts
    return both.repartition("chunk").sortWithinPartitions("chunk", "row").mapInArrow(run, schema)


def _by_kind(batches):
    """Batches cut so that each holds one chunk, and either texts or what they look up."""
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        texts = batch.column("row").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.append(np.union1d(_heads(chunks), _heads(texts)), len(chunks))
        for begin, end in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(begin, end - begin)


def score_documents(docs: DataFrame, hold_out: tuple[int, int] = HOLD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    steps = Steps(spark)
    marked = docs.select(
        "doc_id", (remainder("doc_id", hold_out[0]) == hold_out[1]).alias("held_out"), "text"
    )
    texts = steps.keep(_chunked(marked), "lm_texts", compression="zstd")
    training = texts.filter(~F.col("held_out"))
    vocabulary = steps.keep(word_counts(training), "lm_words")
    total, different = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    none = -float(np.log10(total + different + 1))  # of a token that training never saw
    # at most 1 / COMMON_SHARE words can hold that share each
    often = vocabulary.filter(F.col("n") >= total * COMMON_SHARE).toArrow()
    hashes = often.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    logs = np.log10(often.column("n").to_numpy()[order] + 1.0) + none
    common = spark.sparkContext.broadcast((hashes[order], logs))
    pairs = steps.keep(_chunk_codes(texts), "lm_chunk_codes", compression="zstd")
    counts = steps.keep(pairs.groupBy("code").agg(F.sum("n").alias("n")), "lm_counts", compression="zstd")
    steps.clean()
    seen_codes = counts.filter("n > 0")
    pair = F.shiftleft(F.shiftright("code", 8 * (DEPTH - 1)), 8).bitwiseOR(F.col("code").bitwiseAND(255))
    shallow = seen_codes.groupBy(pair.alias("code")).agg(F.sum("n").alias("n")).toArrow()  # below 2**24 rows
    top = spark.sparkContext.broadcast(top_of(shallow, _sums_below(seen_codes).toArrow()))
    code_chances = steps.keep(_code_chances(counts, top), "lm_chances", compression="zstd")
    steps.drop("lm_counts")
    packed = steps.keep(_packed(pairs.join(code_chances.hint("merge"), "code")), "lm_packed")
    steps.drop("lm_chunk_codes", "lm_chances")
    scored = steps.keep(_scored(texts, packed, common), "lm_scored", compression="zstd")
    steps.drop("lm_texts", "lm_packed")
    seen = (
        scored.select("row", F.explode("rare").alias("word"))
        .join(vocabulary.filter(F.col("n") < total * COMMON_SHARE), "word")
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("seen"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    )
    unseen_base = F.size("rare") * F.lit(none)
    return scored.join(seen, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("common") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + unseen_base + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        "score",
    )

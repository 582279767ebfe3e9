"""Repeated byte strings across documents, by a hash-compared suffix sort.

A window is a string of ``WINDOW`` bytes inside one text; it is a repeat if the same string also
starts earlier (smaller doc_id, or earlier in the same document). Every byte of a repeat goes.

1. Each window has an anchor: the place in it whose ``GRAM`` bytes have the smallest hash, the
   leftmost if several do. Equal windows have equal anchors, so only places with equal anchor
   bytes can hold equal windows. Neighbouring windows with one anchor form a span; the spans of a
   corpus are a few per cent of its bytes, and they carry hashes, not text.
2. Spans whose anchor bytes occur once in the corpus are done. Of spans with equal bytes (128-bit
   hash) all but the first are repeats as a whole.
3. The first spans of all classes that share an anchor are compared with each other: their bytes
   are fetched, and the suffixes from the anchor on, and the reversed prefixes before it, are
   sorted by merging. Suffixes are compared through prefix polynomial hashes: binary search over
   equal hashes finds their common extension, so a comparison takes a logarithmic number of
   steps. The sorted order is checked against the bytes themselves; a group where a hash lied is
   sorted by its bytes. Common extensions of neighbours then tell, for every offset of a window
   around the anchor, which spans hold the same window, and all but the first are repeats.
4. An anchor with more than ``LARGE_GROUP`` classes is too large for one task. Its windows are
   hashed one by one instead, and an aggregation finds the first of each.

Overlapping and touching repeats are joined to maximal runs at the end. Null texts read as empty;
texts shorter than a window keep everything. Every row has its
own written number, so no two texts are ever taken for each other. Rows that repeat a doc_id count as
one document in the order (the same string at the same place is no repeat of itself); rows without
an id are documents of their own and come last, by the hash of their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import Steps, text_column
from kerbside.llm.text_hashes import mixed, piece_hashes, prefix_hashes, text_bytes

WINDOW = 100
GRAM = 20
LARGE_GROUP = 4_096
SEGMENT = 1 << 18


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def spans(text: np.ndarray):
    """(first window, number of windows, anchor place, anchor hash) arrays of one text's bytes."""
    n = len(text) - WINDOW + 1
    reach = WINDOW - GRAM + 1
    firsts, counts, places, hashes = [], [], [], []
    for begin in range(0, n, SEGMENT):
        end = min(begin + SEGMENT, n)
        part = text[begin : end + WINDOW - 1]
        prefix = prefix_hashes(part)
        at = np.arange(len(part) - GRAM + 1)
        grams = mixed(piece_hashes(prefix, at, at + GRAM))
        # the upper bits of the hash decide, then the leftmost place
        ranked = (grams & ~np.uint64(0xFFFFF)) | at.astype(np.uint64)
        anchor = (_smallest(ranked, reach) & np.uint64(0xFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        firsts.append(starts + begin)
        counts.append(np.diff(np.append(starts, end - begin)))
        places.append(anchor[starts] + begin)
        hashes.append(grams[anchor[starts]])
    return tuple(np.concatenate(x) for x in (firsts, counts, places, hashes))


# A span's place is one number, ordered by its first window: 32 bits first window, 7 bits number of
# windows less 1, 7 bits distance from the first window to the anchor.
def packed(first, count, distance):
    return (first << 14) | ((count - 1) << 7) | distance


def unpacked(place):
    return place >> 14, ((place >> 7) & 127) + 1, place & 127


#: In this order windows are earlier or later: rows without an id last, place by place.
_ORDER = ["last", "id", "place", "row"]


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, last (no id), id (or the text's hash), row (a number of its own), text. To be written
    once, because the numbers depend on how the rows are read."""
    return docs.select(
        "doc_id",
        F.col("doc_id").isNull().alias("last"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        "text",
    )


def _all_spans(docs: DataFrame) -> DataFrame:
    """anchor, span (hash of all bytes the span's windows cover), last, id, place, row."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(text_column(batch))
            ids = batch.column("id").to_numpy()
            numbers = batch.column("row").to_numpy()
            lasts = batch.column("last").to_numpy(zero_copy_only=False)
            held: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for row in range(batch.num_rows):
                text = data[offsets[row] : offsets[row + 1]]
                if len(text) < WINDOW:
                    continue
                first, count, place, grams = spans(text)
                whole = text.tobytes()
                ends = first + count + WINDOW - 1
                own = np.array(
                    [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(first.tolist(), ends.tolist())], np.uint64
                )
                held[0].append(grams)
                # with the anchor's own hash beside it, a class is named by 128 bits
                held[1].append(mixed(own + (place - first).astype(np.uint64)))
                held[2].append(np.full(len(first), ids[row]))
                held[3].append(packed(first, count, place - first))
                held[4].append(np.full(len(first), numbers[row]))
                held[5].append(np.full(len(first), lasts[row]))
                if sum(map(len, held[0])) > 200_000:
                    yield _as_batch(held)
                    held = [[], [], [], [], [], []]
            if held[0]:
                yield _as_batch(held)

    def _as_batch(held):
        columns = [np.concatenate(h) for h in held]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c.view(np.int64)) for c in columns[:5]), pa.array(columns[5])],
            names=["anchor", "span", "id", "place", "row", "last"],
        )

    return docs.select("last", "id", "row", "text").mapInArrow(
        run, "anchor long, span long, id long, place long, row long, last boolean"
    )


def _wanted(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Each text that has places, with its sorted list of them (at most its own spans)."""
    per_text = places.groupBy("row").agg(F.collect_list("item").alias("items"))
    return docs.join(per_text, "row")


def _contexts(wanted: DataFrame) -> DataFrame:
    """anchor, last, id, place, row, left (bytes before the anchor, reversed), right (bytes from it on), for
    spans of moderate groups; and window and its place of every window of those of large groups."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            windows: list[list] = [[], [], []]
            for number, (whole, items) in enumerate(
                zip(
                    batch.column("text").cast(pa.large_binary()).to_pylist(),
                    batch.column("items").to_pylist(),
                )
            ):
                for item in items:
                    first, count, distance = unpacked(item["place"])
                    if item["large"]:
                        for at in range(first, first + count):
                            windows[0].append(xxhash.xxh3_128_digest(whole[at : at + WINDOW]))
                            windows[1].append(number)
                            windows[2].append(packed(at, 1, 0))
                        continue
                    anchor = first + distance
                    for column, value in zip(
                        out,
                        (
                            item["anchor"],
                            number,
                            item["place"],
                            whole[first:anchor][::-1],
                            whole[anchor : first + count + WINDOW - 1],
                        ),
                    ):
                        column.append(value)
            n, m = len(out[0]), len(windows[0])
            owner = pa.array(out[1] + windows[1], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0] + [None] * m, pa.int64()),
                    *(batch.column(name).take(owner) for name in ("last", "id", "row")),
                    pa.array(out[2] + windows[2], pa.int64()),
                    pa.array(out[3] + [None] * m, pa.binary()),
                    pa.array(out[4] + [None] * m, pa.binary()),
                    pa.array([None] * n + windows[0], pa.binary()),
                ],
                names=["anchor", "last", "id", "row", "place", "left", "right", "window"],
            )

    return wanted.select("text", "last", "id", "row", "items").mapInArrow(
        run, "anchor long, last boolean, id long, row long, place long, left binary, right binary, window binary"
    )


class Suffixes:
    """Strings in one buffer with prefix hashes; compares and sorts many pairs at a time."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.prefix = prefix_hashes(self.data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of each pair, by binary search over equal hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.length[a], self.length[b])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = piece_hashes(self.prefix, self.start[a], self.start[a] + middle) == piece_hashes(
                self.prefix, self.start[b], self.start[b] + middle
            )
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a < b, and whether a == b."""
        shared = self.common(a, b)
        ends_a, ends_b = shared == self.length[a], shared == self.length[b]
        last = max(0, len(self.data) - 1)
        next_a = self.data[np.minimum(self.start[a] + shared, last)]
        next_b = self.data[np.minimum(self.start[b] + shared, last)]
        return np.where(ends_a | ends_b, ends_a & ~ends_b, next_a < next_b), ends_a & ends_b

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of all strings by group (which is sorted already) and content: merges runs of
        growing length, all groups and runs of a round at once."""
        n = len(group)
        order = np.arange(n)
        if not n:
            return order
        begin = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - begin
        within, width = np.arange(n) - begin, 1
        while width < size.max(initial=0):
            run = within // width
            other = run ^ 1
            low = np.minimum(other * width, size)
            high = np.minimum(low + width, size)
            active = np.flatnonzero(low < high)
            left, right = low[active].copy(), high[active].copy()
            is_left = run[active] % 2 == 0
            own = order[active]
            while True:
                open_ = np.flatnonzero(left < right)
                if not len(open_):
                    break
                middle = (left[open_] + right[open_]) >> 1
                against = order[begin[active[open_]] + middle]
                less, equal = self.before(against, own[open_])
                # of equal strings those of the left run come first
                goes_on = less | (equal & ~is_left[open_])
                left[open_] = np.where(goes_on, middle + 1, left[open_])
                right[open_] = np.where(goes_on, right[open_], middle)
            target = np.arange(n)
            base = begin[active] + (run[active] & ~1) * width
            target[active] = base + (within[active] - run[active] * width) + (left - low[active])
            new = np.empty_like(order)
            new[target] = order
            order, width = new, width * 2
        return order

    def verified(self, order: np.ndarray, group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The order and each string's true common extension with the one before it in its group.

        Neighbours are compared byte by byte; a group whose order does not hold (two different
        pieces had one hash) is sorted by its bytes."""
        for _ in range(2):
            reach = np.zeros(len(order), np.int64)
            same_group = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
            wrong = np.zeros(len(order), bool)
            for some in np.array_split(same_group, max(1, len(same_group) // 20_000)):
                if not len(some):
                    continue
                a, b = order[some - 1], order[some]
                shortest = np.minimum(self.length[a], self.length[b])
                grid = np.arange(shortest.max(initial=0))
                last = len(self.data) - 1
                equal = self.data[np.minimum(self.start[a][:, None] + grid, last)] == self.data[
                    np.minimum(self.start[b][:, None] + grid, last)
                ]
                equal &= grid < shortest[:, None]
                shared = np.where(equal.all(axis=1) & (len(grid) > 0), len(grid), np.argmin(equal, axis=1)) if len(
                    grid
                ) else np.zeros(len(some), np.int64)
                shared = np.minimum(shared, shortest)
                reach[some] = shared
                inside = shared < shortest
                wrong[some] = np.where(
                    inside,
                    self.data[np.minimum(self.start[a] + shared, last)] > self.data[np.minimum(self.start[b] + shared, last)],
                    self.length[a] > self.length[b],
                )
            if not wrong.any():
                return order, reach
            for bad in np.unique(group[order[wrong]]):
                rows = np.flatnonzero(group[order] == bad)
                order[rows] = sorted(order[rows], key=lambda i: strings[i])
        return order, reach


def repeats_of_groups(
    group: np.ndarray,
    last: np.ndarray,
    id_: np.ndarray,
    row: np.ndarray,
    place: np.ndarray,
    left: list[bytes],
    right: list[bytes],
) -> tuple[np.ndarray, np.ndarray]:
    """(row, first byte) of repeated windows. Groups are sorted."""
    first, count, distance = unpacked(place)
    n = len(group)
    sides = []
    for strings in (right, left):
        suffixes = Suffixes(strings)
        order, reach = suffixes.verified(suffixes.sort(group), group, strings)
        sides.append((order, reach))
    (order_r, reach_r), (order_l, reach_l) = sides
    earlier = np.lexsort((row, place, id_, last))
    rank = np.empty(n, np.int64)
    rank[earlier] = np.arange(n)
    out_row, out_first = [], []
    # a window with `before` bytes left of the anchor needs WINDOW - before bytes from it on
    least, most = distance - count + 1, distance
    new_r, new_l = np.empty(n, np.int64), np.empty(n, np.int64)
    boundary = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
    for before in range(max(0, int(least.min(initial=0))), int(most.max(initial=-1)) + 1):
        here = (least <= before) & (before <= most)
        if here.sum() < 2:
            continue
        new_r[order_r] = np.cumsum(boundary | (reach_r < WINDOW - before))
        new_l[order_l] = np.cumsum(boundary | (reach_l < before))
        rows = np.flatnonzero(here)
        rows = rows[np.lexsort((rank[rows], new_l[rows], new_r[rows]))]
        same = np.zeros(len(rows), bool)
        same[1:] = (new_r[rows[1:]] == new_r[rows[:-1]]) & (new_l[rows[1:]] == new_l[rows[:-1]])
        # the first of a run is the earliest window; the same place twice is no repeat
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
        window = first + distance - before
        top = rows[head]
        own = last[rows] | last[top]  # a row without an id is a document of its own
        one_document = np.where(own, row[rows] == row[top], id_[rows] == id_[top])
        is_later = same & (~one_document | (window[rows] != window[top]))
        found = rows[is_later]
        out_row.append(row[found])
        out_first.append(window[found])
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_row), np.concatenate(out_first)


def _joined_windows(row, first):
    """Windows as maximal runs: row, first byte, end byte."""
    order = np.lexsort((first, row))
    row, first = row[order], first[order]
    if not len(first):
        return row, first, first
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] > first[:-1] + WINDOW)])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(first)) - 1
    return row[starts], first[starts], first[ends] + WINDOW


_RANGES = "row long, begin long, end long"


def _sorted_repeats(contexts: DataFrame) -> DataFrame:
    """Ranges of repeats among the spans of each anchor; a task sorts whole groups, a bounded
    number of spans at a time."""

    def done(rows):
        group, last, id_, row, place = (
            np.concatenate([r.column(name).to_numpy(zero_copy_only=False) for r in rows])
            for name in ("anchor", "last", "id", "row", "place")
        )
        left = [x for r in rows for x in r.column("left").to_pylist()]
        right = [x for r in rows for x in r.column("right").to_pylist()]
        columns = _joined_windows(*repeats_of_groups(group, last, id_, row, place, left, right))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["row", "begin", "end"]
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = batch.column("anchor").to_numpy()
            # the last group of a batch may go on in the next one
            cut = int(np.searchsorted(anchors, anchors[-1]))
            if cut:
                yield done([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            elif held and held[-1].column("anchor")[0].as_py() != anchors[0]:
                yield done(held)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield done(held)

    return (
        contexts.filter("anchor is not null")
        .select("anchor", "last", "id", "row", "place", "left", "right")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(run, _RANGES)
    )


def _place_ranges(rows: DataFrame) -> DataFrame:
    """All windows of a place as one range of bytes."""
    first = F.shiftright("place", 14)
    count = F.shiftright("place", 7).bitwiseAND(F.lit(127)) + 1
    return rows.select(
        "row",
        first.alias("begin"),
        (first + count + WINDOW - 1).alias("end"),
    )


def _later_than_first(rows: DataFrame, keys: list[str], firsts: DataFrame) -> DataFrame:
    """Rows that start after the first row of their class (``one``: its place in the order)."""
    return rows.join(firsts, keys).filter(~_at_first())


def _at_first():
    """The place of ``one``: the same start in the same row, or in one that repeats its doc_id."""
    one_document = F.when(F.col("last") | F.col("one.last"), F.col("row") == F.col("one.row")).otherwise(
        F.col("id") == F.col("one.id")
    )
    return one_document & (F.shiftright("place", 14) == F.shiftright("one.place", 14))


def repeated_ranges(keyed: DataFrame, steps: Steps, large_group: int = LARGE_GROUP) -> DataFrame:
    """row, begin, end: byte ranges that repeated windows cover (may overlap)."""
    every = steps.keep(_all_spans(keyed), "sd_spans")
    shared = steps.keep(
        every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "sd_shared"
    )  # written, so that Spark may split the join of an anchor with very many spans
    some = steps.keep(every.join(shared, "anchor", "left_semi"), "sd_some")
    steps.drop("sd_spans", "sd_shared")
    classes = steps.keep(
        some.groupBy("anchor", "span").agg(
            F.min(F.struct(*_ORDER)).alias("one"), F.count(F.lit(1)).alias("n")
        ),
        "sd_classes",
    )
    copies = classes.filter("n > 1").select("anchor", "span", "one")
    whole = steps.keep(_place_ranges(_later_than_first(some, ["anchor", "span"], copies)), "sd_whole")
    # rows that repeat a doc_id hold the first span of a class too: they are compared beside it
    twins = steps.keep(
        some.join(copies, ["anchor", "span"])
        .filter(_at_first() & (F.col("row") != F.col("one.row")))
        .select("anchor", F.struct(*_ORDER).alias("one")),
        "sd_twins",
    )
    steps.drop("sd_some")
    firsts = classes.select("anchor", "one").unionByName(twins)
    several = (
        firsts.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("classes"))
        .filter("classes > 1")
        .select("anchor", (F.col("classes") > large_group).alias("large"))
    )
    compared = firsts.join(several, "anchor").select(
        F.col("one.row").alias("row"),
        F.struct("anchor", F.col("one.place").alias("place"), "large").alias("item"),
    )
    contexts = steps.keep(_contexts(_wanted(keyed, compared)), "sd_contexts")
    steps.drop("sd_classes", "sd_twins")
    sorted_ = steps.keep(_sorted_repeats(contexts), "sd_sorted")
    windows = contexts.filter("window is not null").select("window", *_ORDER)
    first_window = (
        windows.groupBy("window")
        .agg(F.min(F.struct(*_ORDER)).alias("one"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("window", "one")
    )
    single = steps.keep(_place_ranges(_later_than_first(windows, ["window"], first_window)), "sd_windows")
    steps.drop("sd_contexts")
    return whole.unionByName(sorted_).unionByName(single)


def remove_repeats(docs: DataFrame, large_group: int = LARGE_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    steps = Steps(docs.sparkSession)
    rows = docs.select("doc_id").schema
    numbered = steps.keep(_numbered(docs), "sd_rows")
    ranges = repeated_ranges(numbered, steps, large_group)
    per_text = ranges.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    keyed = numbered.select("doc_id", "row", "text").join(per_text, "row", "left")

    def run(batches):
        for batch in batches:
            sizes, removed, counts, digests = [], [], [], []
            column = text_column(batch).cast(pa.large_binary())
            for place in range(batch.num_rows):
                whole = column[place].as_py()
                found = sorted((r["begin"], r["end"]) for r in batch.column("ranges")[place].as_py() or [])
                kept, at, gone, spans_, last = hashlib.sha256(), 0, 0, 0, -1
                for begin, end in found:
                    if begin > last:
                        kept.update(whole[at:begin])
                        spans_ += 1
                        gone += end - begin
                        at = last = end
                    elif end > last:
                        gone += end - last
                        at = last = end
                kept.update(whole[at:])
                sizes.append(len(whole))
                removed.append(gone)
                counts.append(spans_)
                digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = T.StructType(
        [
            *rows.fields,
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    return keyed.select("doc_id", "text", "ranges").mapInArrow(run, schema)

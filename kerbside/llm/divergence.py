"""Source divergence audit: how far the word use of a language's sources lies apart.

Terms are runs of letters A-Z, a-z and of all characters from U+0080 on, with A-Z in lower case. A
language keeps the terms that at least ``LEAST_DOCS`` of its documents hold. Each (lang, source) group,
and each language as a whole, gives a kept term the share ``1 + floor(10**9 (count + 5) / (N + 5 V))``,
where N is the sum of its counts over the kept terms and V their number; all of it in whole numbers.

Counting is length-bucketed packing. The bytes of a run of texts are cut into terms at once. Terms of
up to 8 bytes become one big-endian uint64 and terms of up to 16 bytes two; these are radix-sorted, 16
bits a pass, and counted as runs, first per text and then per group. Longer terms go to buckets by
length (doubling), are padded to the bucket's width and sorted as bytes. A text above ``RUN_BYTES`` is
cut between terms, and the runs of its pieces are counted once more, so memory is bounded by a run and
by the different terms of one text. A task puts the counts of its runs together, at most about ``HELD_ROWS`` of
them, and Spark adds up those of all tasks by (lang, source, term).

Distances between sources are sums over terms. Kept terms fall into chunks of about ``CHUNK_TERMS`` by
hash, and sources into blocks of ``BLOCK_SOURCES``; a task holds one chunk for two blocks, and adds up
|p - q| for the terms that any of these sources has. For all others both shares are those of a count
of 0, so they are added by number at the end. No row is made per term and pair of sources.

Null text, lang and source read as ''. A group without any kept term has N = 0, and a language
without kept terms has value 0 for all its pairs; a language with one source has no pairs. Equal
values rank by the UTF-8 bytes of the item. Repeated rows and ids are separate documents. Other
columns of the table play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import Steps, text_column

LEAST_DOCS = 30
TERM_RANKS = 50
RUN_BYTES = 8 << 20
HELD_ROWS = 1 << 20
CHUNK_TERMS = 2_048
BLOCK_SOURCES = 256

_SCALE = 1_000_000_000
_ADDED = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by uint64 keys, the first key being the most significant."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                # numpy sorts 16-bit keys by counting
                order = order[np.argsort(digit[order], kind="stable")]
    return order


class Counts:
    """Terms of one bucket with a text number and a count each: (keys, text, n).

    ``keys`` are one or two uint64 columns, or one column of padded bytes."""

    def __init__(self, keys: list[np.ndarray], text: np.ndarray, n: np.ndarray):
        self.keys, self.text, self.n = keys, text, n

    def _taken(self, order: np.ndarray) -> Counts:
        return Counts([k[order] for k in self.keys], self.text[order], self.n[order])

    def _starts(self, *more: np.ndarray) -> np.ndarray:
        new = np.zeros(len(self.n), bool)
        new[:1] = True
        for column in (*self.keys, *more):
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    def _order(self) -> np.ndarray:
        if self.keys[0].dtype == np.uint64:
            return radix_order(self.keys)
        return np.argsort(self.keys[0], kind="stable")

    def per_text(self) -> Counts:
        """One row for each term of a text, sorted by (term, text); rows come in text order."""
        found = self._taken(self._order())
        starts = found._starts(found.text)
        if not len(starts):
            return found
        return Counts([k[starts] for k in found.keys], found.text[starts], np.add.reduceat(found.n, starts))

    def per_group(self, group: np.ndarray) -> tuple[Counts, np.ndarray]:
        """From one row per term and text to one per group and term, and how many texts have it."""
        order = np.argsort(group[self.text], kind="stable")
        found = self._taken(order)
        groups = group[found.text]
        starts = found._starts(groups)
        if not len(starts):
            return Counts(found.keys, groups, found.n), found.n
        docs = np.diff(np.append(starts, len(groups)))
        sums = Counts([k[starts] for k in found.keys], groups[starts], np.add.reduceat(found.n, starts))
        return sums, docs

    def terms(self) -> pa.Array:
        if self.keys[0].dtype == np.uint64:
            raw = np.empty((len(self.n), len(self.keys)), ">u8")
            raw.T[:] = self.keys
            padded = raw.view(f"S{8 * len(self.keys)}").reshape(-1)
        else:
            padded = self.keys[0]
        return pa.array(padded.tolist(), pa.binary()).cast(pa.string())


def _term_bounds(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and lengths of all terms; no term crosses a break."""
    inside = _IN_TERM[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[breaks[breaks < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = breaks[(breaks > 0) & (breaks <= len(data))] - 1
    after[ends] = False
    return starts, np.flatnonzero(inside & ~after) + 1 - starts


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each start as one big-endian number, shorter ones padded by zeros.
    ``data`` has 8 spare bytes at its end."""
    windows = np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))
    spare = (8 * (8 - np.minimum(lengths, 8))).astype(np.uint64)
    return windows[starts].astype(np.uint64) >> spare << spare


def _padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    held = np.zeros((len(starts), width), np.uint8)
    for row, (start, length) in enumerate(zip(starts.tolist(), lengths.tolist())):
        held[row, :length] = data[start : start + length]
    return held.view(f"S{width}").reshape(-1)


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> dict[int, Counts]:
    """Per bucket (8, 16, 32, ... bytes) one row for each term of each text; ``offsets`` bound the texts."""
    starts, lengths = _term_bounds(data, offsets[1:-1])
    text = np.searchsorted(offsets, starts, side="right") - 1
    lower = np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])
    found = {}
    for width in (8, 16):
        mine = (lengths <= width) & (lengths > width - 8)
        first, size = starts[mine], lengths[mine]
        keys = [_packed(lower, first + at, size - at) for at in range(0, width, 8)]
        found[width] = Counts(keys, text[mine], np.ones(len(first), np.int64)).per_text()
    while lengths.max(initial=0) > width:
        width *= 2
        mine = (lengths <= width) & (lengths > width // 2)
        if mine.any():
            keys = [_padded(lower, starts[mine], lengths[mine], width)]
            found[width] = Counts(keys, text[mine], np.ones(mine.sum(), np.int64)).per_text()
    return found


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its texts in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if places is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Pieces of one text of about ``limit`` bytes, cut after a byte that is in no term."""
    first = 0
    while len(data) - first > limit:
        end = first + limit
        while True:
            outside = np.flatnonzero(~_IN_TERM[data[end : end + limit]])
            if len(outside) or end >= len(data):
                break
            end += limit
        end = min(len(data), end + (int(outside[0]) + 1 if len(outside) else 0))
        yield data[first:end]
        first = end
    yield data[first:]


def _run_counts(data: np.ndarray, offsets: np.ndarray, limit: int) -> dict[int, Counts]:
    if len(offsets) > 2 or len(data) <= limit:
        return bucket_counts(data, offsets)
    pieces = [bucket_counts(p, np.array([0, len(p)])) for p in _cut(data, limit)]
    found = {}
    for width in {w for p in pieces for w in p}:
        own = [p[width] for p in pieces if width in p]
        keys = [np.concatenate(k) for k in zip(*(o.keys for o in own))]
        joined = [np.concatenate(c) for c in zip(*((o.text, o.n) for o in own))]
        found[width] = Counts(keys, *joined).per_text()
    return found


def _runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Texts [first, last) that together have about ``limit`` bytes, longer ones alone."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = max(first + 1, last)
        yield first, last
        first = last


class _Held:
    """Counts per group and term of one bucket, put together from several runs of texts."""

    def __init__(self):
        self.parts: list[tuple[Counts, np.ndarray]] = []
        self.rows = 0

    def add(self, sums: Counts, docs: np.ndarray) -> None:
        self.parts.append((sums, docs))
        self.rows += len(docs)

    def reduced(self) -> tuple[Counts, np.ndarray]:
        """One row per group and term; ``text`` holds the group."""
        if len(self.parts) > 1:
            keys = [np.concatenate(k) for k in zip(*(c.keys for c, _ in self.parts))]
            group, n = (np.concatenate(c) for c in zip(*((c.text, c.n) for c, _ in self.parts)))
            docs = np.concatenate([d for _, d in self.parts])
            order = Counts(keys, group, n)._order()
            order = order[np.argsort(group[order], kind="stable")]
            both = Counts(keys, group, np.arange(len(n)))._taken(order)
            starts = both._starts(both.text)
            whole = Counts([k[starts] for k in both.keys], both.text[starts], np.add.reduceat(n[both.n], starts))
            self.parts = [(whole, np.add.reduceat(docs[both.n], starts))]
        self.rows = len(self.parts[0][1])
        return self.parts[0]


def term_counts(docs: DataFrame, limit: int = RUN_BYTES, held_rows: int = HELD_ROWS) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""

    def batch_of(names, sums, docs_with):
        langs, sources = (pa.array([n[i] for n in names], pa.string()) for i in (0, 1))
        owners = pa.array(sums.text, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                langs.take(owners), sources.take(owners), sums.terms(),
                pa.array(sums.n, pa.int64()), pa.array(docs_with, pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )

    def count(batches):
        groups: dict[tuple, int] = {}
        held: dict[int, _Held] = {}

        def given():
            for own in held.values():
                if own.rows:
                    yield batch_of(list(groups), *own.reduced())
            held.clear()

        for batch in batches:
            data, offsets = _bytes_of(text_column(batch))
            names = zip(*(batch.column(c).to_pylist() for c in ("lang", "source")))
            group = np.array([groups.setdefault(name, len(groups)) for name in names], np.int64)
            for first, last in _runs(offsets, limit):
                part = data[offsets[first] : offsets[last]]
                counted = _run_counts(part, offsets[first : last + 1] - offsets[first], limit)
                for width, found in counted.items():
                    sums, docs_with = found.per_group(group[first:last])
                    held.setdefault(width, _Held()).add(sums, docs_with)
                if sum(own.rows for own in held.values()) > held_rows:
                    for own in held.values():
                        own.reduced()
                    # what different terms there are does not shrink; then the rows go on to Spark
                    if sum(own.rows for own in held.values()) > held_rows // 2:
                        yield from given()
        yield from given()

    return (
        _read(docs)
        .mapInArrow(count, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 5) / (total + 5 terms)), exactly; null without terms."""
    wide = "decimal(20,0)"
    top = F.lit(_SCALE).cast("decimal(10,0)") * (count + F.lit(_ADDED)).cast(wide)
    below = (total + terms * F.lit(_ADDED)).cast(wide)
    return F.when(terms > 0, F.call_function("div", top, below) + 1)


def _groups(docs: DataFrame, cells: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per (lang, source): its place in the language, N, V, the language's N, shares of count 0."""
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    sums = (
        _read(docs).select("lang", "source").distinct()
        .join(own, ["lang", "source"], "left")
        .join(whole, "lang", "left")
        .fillna(0, ["total", "terms", "lang_total"])
    )
    order = Window.partitionBy("lang").orderBy("source")
    return (
        sums.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
        .withColumn("p0", F.coalesce(share(zero, F.col("total"), F.col("terms")), zero))
    )


def _between_sources(cells: DataFrame, groups: DataFrame, chunk_terms: int, block_sources: int) -> DataFrame:
    """lang, source, item (another source) and value, the sum of |p - q| over all kept terms."""
    chunks = F.greatest(F.ceil(F.col("terms") / chunk_terms), F.lit(1)).cast("int")
    block = F.floor(F.col("place") / block_sources).cast("int")
    last_block = F.floor((F.col("sources") - 1) / block_sources).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), last_block),
        lambda other: F.struct(F.least(other, block).alias("a"), F.greatest(other, block).alias("b")),
    )
    named = ["lang", "chunk", "pair.a", "pair.b", "place", "source", "terms", "term", "p"]
    of_sources = (
        groups.filter(F.col("sources") > 1)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumn("pair", F.explode(pairs))
        .withColumn("term", F.lit(None).cast("string"))
        .withColumn("p", F.col("p0"))
        .select(*named)
    )
    of_terms = (
        cells.join(groups, ["lang", "source"])
        .filter(F.col("sources") > 1)
        .withColumn("chunk", F.pmod(F.xxhash64("term"), chunks).cast("int"))
        .withColumn("pair", F.explode(pairs))
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
        .select(*named)
    )

    def distances(held: pd.DataFrame) -> pd.DataFrame:
        sources = held[held["term"].isna()].sort_values("place")
        places, names, zeros = (sources[c].to_numpy() for c in ("place", "source", "p"))
        known = held[held["term"].notna()]
        row, terms = pd.factorize(known["term"])
        shares = np.tile(zeros.astype(np.int64), (len(terms), 1))
        shares[row, np.searchsorted(places, known["place"].to_numpy())] = known["p"].to_numpy()
        a, b = int(held["a"].iloc[0]), int(held["b"].iloc[0])
        left = np.flatnonzero(places // block_sources == a)
        right = np.flatnonzero(places // block_sources == b)
        parts = []
        for one in left:
            others = right if a != b else right[right != one]
            value = np.abs(shares[:, others] - shares[:, [one]]).sum(axis=0)
            apart = np.abs(zeros[others] - zeros[one])
            both = [(names[one], names[others])] if a == b else [
                (names[one], names[others]), (names[others], names[one])
            ]
            for source, item in both:
                parts.append(pd.DataFrame(
                    {"source": source, "item": item, "value": value, "apart": apart}
                ))
        out = pd.concat(parts) if parts else pd.DataFrame(columns=["source", "item", "value", "apart"])
        out["lang"], out["covered"], out["terms"] = held["lang"].iloc[0], len(terms), held["terms"].iloc[0]
        return out[["lang", "source", "item", "value", "apart", "covered", "terms"]]

    schema = "lang string, source string, item string, value long, apart long, covered long, terms long"
    summed = (
        of_sources.unionByName(of_terms)
        .groupBy("lang", "chunk", "a", "b")
        .applyInPandas(distances, schema)
        .groupBy("lang", "source", "item")
        .agg(
            F.sum("value").alias("value"),
            F.sum("covered").alias("covered"),
            F.max("apart").alias("apart"),
            F.max("terms").alias("terms"),
        )
    )
    rest = (F.col("terms") - F.col("covered")) * F.col("apart")
    return summed.select("lang", "source", "item", (F.col("value") + rest).alias("value"))


def _over_used(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term) and value = p - q, where the group's share is above the language's."""
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return (
        cells.join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
        .filter(F.col("value") > 0)
    )


def audit(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    ranks: int = TERM_RANKS,
    chunk_terms: int = CHUNK_TERMS,
    block_sources: int = BLOCK_SOURCES,
    limit: int = RUN_BYTES,
    held_rows: int = HELD_ROWS,
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; see the module's text."""
    steps = Steps(docs.sparkSession)
    counts = steps.keep(term_counts(docs, limit, held_rows), "audit_counts")
    kept = steps.keep(
        counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        .filter(F.col("docs") >= least_docs)
        .select("lang", "term", "lang_n"),
        "audit_kept",
    )
    cells = steps.keep(
        counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "audit_cells"
    )
    steps.drop("audit_counts")
    groups = steps.keep(_groups(docs, cells, kept), "audit_groups")
    steps.drop("audit_kept")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(values: DataFrame, part: str) -> DataFrame:
        return values.withColumn("rank", F.row_number().over(order)).select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", "rank"
        )

    pairs = ranked(_between_sources(cells, groups, chunk_terms, block_sources), "pair")
    terms = ranked(_over_used(cells, groups), "term").filter(F.col("rank") <= ranks)
    return pairs.unionByName(terms)

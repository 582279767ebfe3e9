"""Language identification by nearest centroids of TF-IDF vectors.

A text's letters, in lower case and with one blank for whatever stands between words, are read as
n-grams of one to three characters, hashed to ``BUCKETS`` places. A place weighs
``(1 + ln count) * (1 + ln((1 + N) / (1 + documents that have it)))``, and vectors have length 1. Document
counts are taken over all training documents. Per language at most ``FIT_ROWS`` different texts (those
of smallest hash) are clustered by spherical k-means into ``CLUSTERS`` centroids: long and short texts,
shouting, lists and code lie far apart within a language. A cluster that holds less than ``LEAST_SHARE``
of its language's sample and lies nearer to another language's texts than to its own is left out, so
that a few wrong labels found no cluster of their own.

A text gets the language of the centroid with the largest cosine, and that cosine (0 to 1) as its score.
It is ``rejected`` if its distance (1 - cosine) is above ``SLACK`` times that of nearly all
(``WITHIN``) sampled texts of that centroid; short texts lie far from all centroids and are often
rejected. ``identify(..., reject=True)`` gives rejected texts the language ``UNKNOWN`` too.

Learnt from: text and language of training rows whose language is not null. Null texts and texts without
a letter are ``UNKNOWN`` with score 0, as is everything if nothing was learnt. Equal cosines go to the
language that sorts first. Whole texts are read, in pieces of about ``PIECE`` characters that end where
a word ends (a word beyond that is cut). Repeated rows are rows of their own, of which a sample holds one;
other columns of the table play no part. The model takes ``CLUSTERS * BUCKETS * 4`` bytes a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import Steps, let_workers_import, remainder, text_slices

HOLD_OUT = (5, 0)  # ids with this remainder of crc32 are never learnt from
UNKNOWN = "und"
BUCKETS = 1 << 14
FIT_ROWS = 512
CLUSTERS = 4
LEAST_SHARE = 0.1
ROUNDS = 12
WITHIN = 0.99
SLACK = 1.1
PIECE = 1 << 20

_FACTORS = tuple(np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _pieces(text: str, size: int = PIECE) -> Iterator[str]:
    first = 0
    while len(text) - first > size:
        end = first + size
        while end < min(len(text), first + 2 * size) and text[end].isalpha():
            end += 1
        yield text[first:end]
        first = end
    yield text[first:]


def _hashed(codes: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    wide = codes.astype(np.uint64) + np.uint64(1)
    mixed = wide * _FACTORS[0]
    yield ((mixed ^ (mixed >> np.uint64(29))) * _FACTORS[2]) >> shift
    for n in (1, 2):
        mixed = mixed[:-1] * _FACTORS[1] + wide[n:] * _FACTORS[0]
        yield ((mixed ^ (mixed >> np.uint64(29))) * _FACTORS[2]) >> shift


def gram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """How often each place is hit, or None if the text has no letter."""
    counts = None
    for piece in _pieces(text):
        codes = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _letters()[codes]
        if not inside.any():
            continue
        # a blank before the first and after the last word, and one between words
        held = np.concatenate([[32], np.where(inside, codes, 32), [32]])
        between = held == 32
        held = held[~(between & np.concatenate([[False], between[:-1]]))]
        for places in _hashed(held, buckets):
            own = np.bincount(places.astype(np.int64), minlength=buckets)
            counts = own if counts is None else counts + own
    return counts


def weights(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a vector of length 1."""
    places = np.flatnonzero(counts)
    values = (1 + np.log(counts[places])) * idf[places]
    return places, values / np.sqrt((values**2).sum())


@dataclass(frozen=True)
class Model:
    """Names, centroids (places x centroids) and the distance up to which a centroid's texts lie."""

    names: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray = field(repr=False)

    def nearest(self, text: str, slack: float) -> tuple[str, float, bool]:
        counts = gram_counts(text, len(self.idf)) if self.names else None
        if counts is None:
            return UNKNOWN, 0.0, True
        places, values = weights(counts, self.idf)
        cosines = values @ self.centroids[places]
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.names[best], score, 1 - score > slack * float(self.reach[best])


def training_rows(docs: DataFrame, hold_out: tuple[int, int] = HOLD_OUT) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(
        (remainder("doc_id", hold_out[0]) != hold_out[1]) & F.col("text").isNotNull() & F.col("lang").isNotNull()
    )


def document_counts(rows: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Documents that have each place, and all documents with a letter (place -1 in the table).

    A task adds up its texts and gives at most one row a place, so the driver gets ``buckets`` rows."""

    def count(batches):
        found, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for _, texts in text_slices(batch):
                for text in texts:
                    counts = gram_counts(text, buckets)
                    if counts is not None:
                        found += counts > 0
                        n += 1
        places = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(places, -1), pa.int64()), pa.array(np.append(found[places], n), pa.int64())],
            names=["place", "n"],
        )

    sums = rows.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    held, n = np.zeros(buckets, np.int64), 0
    for row in sums.collect():
        if row.place < 0:
            n = row.n
        else:
            held[row.place] = row.n
    return held, n


def sample(rows: DataFrame, steps: Steps, limit: int = FIT_ROWS) -> DataFrame:
    """lang, text: at most ``limit`` different texts per language, those of smallest hash."""
    key = F.xxhash64("text").alias("key")
    keys = steps.keep(rows.select("lang", key).distinct(), "language_keys")
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))
    # a bound on the hash that about twice as many fall under, so that no task sorts a whole language
    place = F.shiftrightunsigned("key", 11)
    order = Window.partitionBy("lang").orderBy(place, "key")
    chosen = (
        keys.join(F.broadcast(counts), "lang")  # a row per language
        .filter(place.cast("double") * F.col("held") <= 2.0 * limit * 2.0**53)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
        .select("lang", "key")
    )
    return (
        rows.select("lang", "text", key)
        .join(F.broadcast(chosen), ["lang", "key"])  # ``limit`` rows a language
        .groupBy("lang", "key")
        .agg(F.min("text").alias("text"))
        .select("lang", "text")
    )


def _vectors(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def weigh(batches):
        own = shared.value
        for batch in batches:
            for first, texts in text_slices(batch):
                langs = batch.column("lang").slice(first, len(texts)).to_pylist()
                for lang, text in zip(langs, texts):
                    counts = gram_counts(text, len(own))
                    if counts is None:
                        continue
                    places, values = weights(counts, own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang], pa.string()),
                            pa.array([places], pa.list_(pa.int32())),
                            pa.array([values], pa.list_(pa.float64())),
                        ],
                        names=["lang", "places", "values"],
                    )

    return rows.mapInArrow(weigh, "lang string, places array<int>, values array<double>")


def cluster(vectors: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length 1 (rows) and the cluster of each vector.

    Starts from vectors evenly spaced in the order of their cosine with the mean, so that single
    odd texts found no cluster; the vectors come in a fixed order."""
    order = np.argsort(vectors @ vectors.sum(axis=0), kind="stable")
    spaced = (np.arange(clusters) + 0.5) * len(order) / clusters
    chosen = order[np.unique(spaced.astype(int))]
    centroids, owner = vectors[chosen], np.full(len(vectors), -1)
    for _ in range(rounds):
        now = np.argmax(vectors @ centroids.T, axis=1)
        if (now == owner).all():
            break
        owner = now
        sums = np.stack([vectors[owner == c].sum(axis=0) for c in range(len(centroids))])
        length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-300), centroids)
    return centroids, owner


def _centroids(vectors: DataFrame, buckets: int) -> DataFrame:
    """One row per language and cluster; a task holds one language's sample (``FIT_ROWS`` vectors)."""

    def fit(held: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(held["places"], held["values"]), key=lambda r: (len(r[0]), r[0].tobytes(), r[1].tobytes()))
        dense = np.zeros((len(rows), buckets), np.float32)
        for at, (places, values) in enumerate(rows):
            dense[at, places] = values
        centroids, owner = cluster(dense)
        out = []
        for c, centroid in enumerate(centroids):
            own = dense[owner == c] @ centroid
            if len(own):
                reach = float(np.quantile(1 - own, WITHIN))
                out.append((held["lang"].iloc[0], c, len(own) / len(rows), reach, centroid.astype(np.float32)))
        return pd.DataFrame(out, columns=["lang", "cluster", "share", "reach", "centroid"])

    schema = "lang string, cluster int, share double, reach double, centroid array<float>"
    return vectors.groupBy("lang").applyInPandas(fit, schema)


def _kept(rows: list) -> list:
    """Without small clusters that lie nearer to the main cluster of another language."""
    main = {}
    for row in rows:
        if row.lang not in main or row.share > main[row.lang].share:
            main[row.lang] = row
    kept = []
    for row in rows:
        own = np.array(row.centroid)
        nearest = max(main, key=lambda lang: (float(own @ np.array(main[lang].centroid)), lang == row.lang))
        if row is main[row.lang] or row.share >= LEAST_SHARE or nearest == row.lang:
            kept.append(row)
    return kept


def fit(
    docs: DataFrame, limit: int = FIT_ROWS, hold_out: tuple[int, int] = HOLD_OUT, buckets: int = BUCKETS
) -> Model:
    let_workers_import(docs.sparkSession)
    rows = training_rows(docs, hold_out)
    held, n = document_counts(rows, buckets)
    idf = 1 + np.log((1 + n) / (1 + held))
    chosen = sample(rows, Steps(docs.sparkSession), limit)
    found = _centroids(_vectors(chosen, idf), buckets).orderBy("lang", "cluster").collect()
    kept = _kept(found)
    return Model(
        [r.lang for r in kept],
        idf,
        np.array([r.centroid for r in kept], np.float32).reshape(-1, buckets).T.copy(),
        np.array([r.reach for r in kept]),
    )


def identify(
    docs: DataFrame, model: Model, keep: list[str] | None = None, reject: bool = False, slack: float = SLACK
) -> DataFrame:
    """Adds lang_pred, score and rejected; the columns named in ``keep`` stay, or all."""
    added = ("lang_pred", "score", "rejected")
    rest = [c for c in keep or docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            for first, texts in text_slices(batch):
                found = [own.nearest(text, slack) for text in texts]
                names = [UNKNOWN if reject and far else name for name, _, far in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(first, len(texts)).select(rest).columns,
                        pa.array(names, pa.string()),
                        pa.array([score for _, score, _ in found], pa.float64()),
                        pa.array([far for _, _, far in found], pa.bool_()),
                    ],
                    names=[*rest, *added],
                )

    schema = T.StructType(
        [docs.schema[c] for c in rest]
        + [
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return docs.mapInArrow(run, schema)


def held_out(hold_out: tuple[int, int] = HOLD_OUT) -> Column:
    return remainder("doc_id", hold_out[0]) == hold_out[1]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")

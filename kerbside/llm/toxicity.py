"""Toxicity by weak supervision.

1. Candidate stems (whole words, and word beginnings of 4 to 6 letters) are counted over labelled
   rows; a greedy cover chooses the lexicon: at each step the stem that adds the most toxic rows
   not yet covered ``COVER`` times, less ``CLEAN_COST`` times its clean rows.
2. Every stem of the lexicon is a voter for "toxic", and patterns of the whole text vote too
   (several different stems, dense stems, no stem at all, no stem in a long text, shouting).
   Voters may abstain.
3. A generative model of the votes, with the true class hidden, estimates each voter's accuracy by
   expectation maximisation. Correlations between voters that remain given the class are
   estimated from the residuals; correlated voters share their weight, and the model is fitted
   again.
4. A linear (logistic) classifier is trained on the posterior classes and scores every text.

Only rows of ``labels`` outside the held-out part are read as labels, at most ``FIT_ROWS`` of
them (smallest hash of the id); ids, sources, languages and labels are no inputs of a score.

Null texts read as empty and get the score of a text without votes; documents without a label
only get a score; labels that are null, or whose document is missing, count for nothing; several
labels of one id count as toxic if any is; without any toxic label every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import remainder, text_slices

HOLD_OUT = (4, 2)  # ids with this remainder of crc32 are never learnt from
FIT_ROWS = 20_000
CANDIDATES = 4_000
LEXICON = 400
LEAST_ROWS = 5
COVER = 3
CLEAN_COST = 3
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b")
PATTERNS = ("several stems", "dense stems", "no stem", "no stem in a long text", "shouting")


def stems(words: Iterable[str]) -> Iterator[str]:
    """Beginnings of each word, and the word itself (marked by a closing space)."""
    for word in words:
        yield f"{word} "
        for n in (4, 5, 6):
            if len(word) > n:
                yield word[:n]


class Lexicon:
    """Finds stems at the beginnings of words in one pass over a text."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self._finder = ahocorasick.Automaton()
        for place, entry in enumerate(entries):
            self._finder.add_word(entry.rstrip(), [])
        for place, entry in enumerate(entries):
            self._finder.get(entry.rstrip()).append((place, entry.endswith(" ")))
        if entries:
            self._finder.make_automaton()

    def hits(self, text: str) -> Counter:
        """How often each entry (by place) occurs."""
        found: Counter = Counter()
        if not self.entries:
            return found
        lower = text.lower()
        for last, owners in self._finder.iter(lower):
            follows = last + 1 < len(lower) and lower[last + 1].isalpha()
            for place, whole in owners:
                start = last + 1 - len(self.entries[place].rstrip())
                if (start == 0 or not lower[start - 1].isalpha()) and not (whole and follows):
                    found[place] += 1
        return found


def pattern_votes(text: str, hits: Counter) -> list[int]:
    """1 toxic, -1 clean, 0 abstains; one vote per entry of PATTERNS."""
    different, all_hits = len(hits), sum(hits.values())
    long = len(text) > 2_000
    return [
        1 if different >= 2 else 0,
        1 if all_hits * 1_000 > len(text) else 0,
        -1 if different == 0 else 0,
        -1 if different == 0 and long else 0,
        1 if len(_SHOUT.findall(text)) * 500 > len(text) else 0,
    ]


def features(text: str, lexicon: Lexicon) -> tuple[list[int], list[int], float]:
    """Places of the stems found, the pattern votes, and stems per thousand characters."""
    hits = lexicon.hits(text)
    return sorted(hits), pattern_votes(text, hits), min(5.0, 1_000 * sum(hits.values()) / (len(text) + 1))


@dataclass(frozen=True)
class Model:
    """Lexicon and the weights of the linear classifier."""

    entries: list[str]
    weights: np.ndarray  # stems, patterns, density, constant

    def score(self, text: str, lexicon: Lexicon) -> float:
        places, votes, density = features(text, lexicon)
        n = len(self.entries)
        total = self.weights[places].sum() + np.dot(self.weights[n : n + len(votes)], votes)
        total += self.weights[-2] * density + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def label_model(votes: np.ndarray, prior: float, guess: np.ndarray, rounds: int = 25):
    """Posterior chance of "toxic" per row, accuracies, and correlations between voters.

    votes: rows x voters of -1, 0, 1. ``guess`` starts the expectation maximisation.
    """
    kinds = np.stack([votes == -1, votes == 0, votes == 1]).astype(float)
    share = np.ones(votes.shape[1])
    chance = guess.astype(float)
    correlation = np.eye(votes.shape[1])
    for phase in range(2):
        for _ in range(rounds):
            mass = np.array([(1 - chance).sum(), chance.sum()])
            # chance of each vote given the class, with one imagined vote of each kind
            given = np.stack(
                [
                    (np.einsum("kij,i->kj", kinds, w) + 0.5) / (m + 1.5)
                    for w, m in zip((1 - chance, chance), mass)
                ]
            )
            odds = np.log(given[1]) - np.log(given[0])
            total = np.einsum("kij,kj->i", kinds, odds * share)
            total += np.log(prior / (1 - prior))
            chance = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        if phase == 0:
            expected = np.stack([g[2] - g[0] for g in given])
            rest = votes - (chance[:, None] * expected[1] + (1 - chance)[:, None] * expected[0])
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
            correlation = (rest.T @ rest) / len(votes) / np.outer(spread, spread)
            share = 1 / np.maximum(1, (np.abs(correlation) * (np.abs(correlation) > 0.1)).sum(axis=0))
    accuracy = np.where(given[1][2] + given[0][0] > 0, given[1][2] / (given[1][2] + given[0][2]), 0.5)
    return chance, accuracy, correlation


def fit_linear(x: np.ndarray, chance: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels, with a small ridge penalty, by scaled gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights, squares = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        now = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (chance - now) - 0.05 * weights
        squares += gradient**2
        weights += 0.5 * gradient / np.sqrt(squares + 1e-8)
    return weights


def choose(rows: list[tuple[int, list[int]]], n_candidates: int) -> list[int]:
    """Greedy cover of the toxic rows, ``COVER`` times each, by candidates (places)."""
    owners: list[list[int]] = [[] for _ in range(n_candidates)]
    for row, (_, places) in enumerate(rows):
        for place in places:
            owners[place].append(row)
    toxic = np.array([label for label, _ in rows], bool)
    members = [np.array(o, dtype=int) for o in owners]
    covered = np.zeros(len(rows), int)
    chosen = []
    while len(chosen) < LEXICON:
        gains = [
            (toxic[m] & (covered[m] < COVER)).sum() - CLEAN_COST * (~toxic[m]).sum()
            for m in members
        ]
        best = int(np.argmax(gains)) if gains else 0
        if not gains or gains[best] < LEAST_ROWS:
            break
        chosen.append(best)
        covered[members[best]] += 1
        members[best] = members[best][:0]
    return chosen


def training_rows(
    docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, hold_out: tuple[int, int] = HOLD_OUT
) -> DataFrame:
    """text, toxic of at most ``limit`` labelled rows that are not held out; each text once."""
    ids = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .filter(remainder("doc_id", hold_out[0]) != hold_out[1])
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)  # so the broadcast side has at most so many rows
    )
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")
        .filter(F.col("text").isNotNull())
        .groupBy(F.xxhash64("text").alias("same"))
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("text", "toxic")
    )


def _candidates(rows: DataFrame) -> list[str]:
    """Stems of several toxic rows and mostly of those, the most frequent first."""

    def count(batches):
        for batch in batches:
            for first, texts in text_slices(batch):
                flags = batch.column("toxic").slice(first, len(texts)).to_pylist()
                seen = [Counter(), Counter()]
                for text, flag in zip(texts, flags):
                    seen[flag].update(set(stems(set(_WORD.findall(text.lower())))))
                every = list(seen[1]) + [s for s in seen[0] if s not in seen[1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(every, pa.string()),
                        pa.array([seen[1][s] for s in every], pa.int64()),
                        pa.array([seen[0][s] for s in every], pa.int64()),
                    ],
                    names=["stem", "toxic", "clean"],
                )

    counted = (
        rows.mapInArrow(count, "stem string, toxic long, clean long")
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= LEAST_ROWS) & (F.col("clean") * 3 <= F.col("toxic")))
    )
    top = counted.orderBy((F.col("toxic") - CLEAN_COST * F.col("clean")).desc(), "stem").limit(CANDIDATES)
    return [r.stem for r in top.collect()]


def _found(rows: DataFrame, entries: list[str]) -> list:
    """toxic, places, votes, density of the sampled rows (bounded by FIT_ROWS)."""

    def look(batches):
        lexicon = Lexicon(entries)
        for batch in batches:
            for first, texts in text_slices(batch):
                own = [features(t, lexicon) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("toxic").slice(first, len(texts)),
                        pa.array([f[0] for f in own], pa.list_(pa.int32())),
                        pa.array([f[1] for f in own], pa.list_(pa.int32())),
                        pa.array([f[2] for f in own], pa.float64()),
                    ],
                    names=["toxic", "places", "votes", "density"],
                )

    schema = "toxic int, places array<int>, votes array<int>, density double"
    found = rows.mapInArrow(look, schema).collect()
    return sorted((r.toxic, list(r.places), list(r.votes), r.density) for r in found)


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, hold_out=HOLD_OUT) -> Model:
    rows = training_rows(docs, labels, limit, hold_out)
    candidates = _candidates(rows)
    chosen = choose([(r[0], r[1]) for r in _found(rows, candidates)], len(candidates))
    entries = [candidates[c] for c in chosen]
    sample = _found(rows, entries)
    toxic = np.array([r[0] for r in sample], float)
    n, width = len(entries), len(PATTERNS)
    if not len(toxic) or toxic.max() == 0:
        return Model([], np.array([0.0] * width + [0.0, -30.0]))
    votes = np.zeros((len(sample), n + width), np.int8)
    for row, (_, places, patterns, _) in enumerate(sample):
        votes[row, places] = 1
        votes[row, n:] = patterns
    prior = float(np.clip(toxic.mean(), 0.01, 0.99))
    chance, _, _ = label_model(votes, prior, np.clip(toxic, 0.05, 0.95))
    x = np.hstack([votes, np.array([[r[3]] for r in sample])])
    return Model(entries, fit_linear(x, chance))


def score(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    out: str = "toxicity",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append the score of each text (0 to 1); the columns named in ``keep`` stay, or all."""
    rest = [name for name in keep or docs.columns if name != out]
    schema = T.StructType([*(docs.schema[n] for n in rest), T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        lexicon = Lexicon(own.entries)
        for batch in batches:
            for first, texts in text_slices(batch, text):
                part = batch.slice(first, len(texts)).select(rest)
                scores = [own.score(t, lexicon) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores, pa.float64())], names=[*rest, out]
                )

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), model, out="score", keep=["doc_id"])
    return scored.select(
        "doc_id",
        (remainder("doc_id", HOLD_OUT[0]) == HOLD_OUT[1]).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows predicted toxic; columns are those of ``docs``."""
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        lexicon = Lexicon(own.entries)
        for batch in batches:
            for first, texts in text_slices(batch):
                keep = [own.score(t, lexicon) < threshold for t in texts]
                yield batch.slice(first, len(texts)).filter(pa.array(keep, pa.bool_()))

    return docs.select(*(f"`{c}`" for c in columns)).mapInArrow(run, docs.schema)

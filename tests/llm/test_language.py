"""Language identification: counts, clusters, held-out accuracy and edge cases."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kerbside.llm import language
from tests.llm.data import documents, nothing

WORDS = {
    "en": "the mill on river and stone lamp with cart field north bridge this".split(),
    "de": "der und nicht straße mühle fluß über schön wagen feld brücke nord ich".split(),
    "fr": "le moulin rivière été pierre lampe avec champ où leçon pont vous".split(),
}


def plain_grams(text):
    word = "".join(c if c.isalpha() else " " for c in text.lower())
    held = " " + " ".join(word.split()) + " "
    return Counter(held[i : i + n] for n in (1, 2, 3) for i in range(len(held) - n + 1))


def test_gram_counts_are_the_plain_ones():
    for text in ("Mühle 12 am-Fluß", "a", "雨 ABC!!abc", "  x\n\ny"):
        counts = language.gram_counts(text, 1 << 20)
        grams = plain_grams(text)
        assert sorted(counts[counts > 0].tolist()) == sorted(grams.values())
    assert language.gram_counts(" 12 .", 64) is None and language.gram_counts("", 64) is None


def test_pieces_of_long_texts_add_up():
    text = " ".join(random.Random(1).choices(WORDS["de"], k=900))
    pieces = list(language._pieces(text, 100))
    assert "".join(pieces) == text and max(map(len, pieces)) <= 200
    whole = language.gram_counts(text)
    in_pieces = sum(language.gram_counts(p) for p in pieces)
    # each cut gives one blank more where a word begins or ends
    assert np.abs(whole - in_pieces).sum() <= 5 * len(pieces)


def test_clusters_are_stable_and_have_length_one():
    draw = np.random.default_rng(2)
    vectors = np.abs(np.vstack([draw.normal(size=(30, 8)) + 4 * np.eye(8)[k] for k in (0, 3, 5)]))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    centroids, owner = language.cluster(vectors, 3)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1)
    assert (np.argmax(vectors @ centroids.T, axis=1) == owner).all()
    same, _ = language.cluster(vectors, 3)
    assert (same == centroids).all()
    alone, _ = language.cluster(vectors[:1], 4)
    assert np.allclose(alone, vectors[:1])


def corpus(spark, n=400):
    draw = random.Random(4)
    rows = []
    for i in range(n):
        lang = draw.choice(list(WORDS))
        text = " ".join(draw.choices(WORDS[lang], k=draw.choice([3, 12, 60])))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang if i % 50 else draw.choice(list(WORDS)), -1.0))
    rows += [(n, None, "en", 0.0), (n + 1, "12 34 --", "de", 0.0), (n + 2, "", None, 0.0), (None, "der fluß", None, 0.0)]
    rows += [rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_held_out_accuracy_and_edges(spark):
    docs = corpus(spark)
    found = language.predict(docs, language.fit(docs, limit=64))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    true = {r.doc_id: r for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400]
    right = [r for r in held if set(true[r.doc_id].text.lower().split()) <= set(WORDS[r.lang_pred])]
    assert len(held) > 40 and len(right) >= 0.95 * len(held)
    edges = {r.doc_id: r for r in rows if r.doc_id is None or r.doc_id >= 400}
    assert all(edges[i].lang_pred == language.UNKNOWN and edges[i].score == 0 for i in (400, 401, 402))
    assert edges[None].lang_pred == "de"


def test_far_texts_are_rejected(spark):
    docs = corpus(spark)
    model = language.fit(docs, limit=64)
    far = spark.createDataFrame([(1, "雨が降る 山と川", 5), (2, "the mill on the river and the bridge with this lamp", 5)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in language.identify(far, model, reject=True).collect()}
    assert rows[1].lang_pred == language.UNKNOWN and rows[1].rejected
    assert rows[2].lang_pred == "en" and not rows[2].rejected


def test_held_out_rows_teach_nothing(spark):
    docs = corpus(spark).filter("doc_id is not null")
    other = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    first, second = (language.fit(d, limit=32) for d in (docs, other))
    assert first.names == second.names and (first.centroids == second.centroids).all()


def test_clashing_columns_and_empty_tables(spark):
    docs = documents(spark)
    found = language.predict(docs, language.fit(docs))
    assert found.count() == docs.count()
    model = language.fit(nothing(spark))
    assert language.predict(nothing(spark), model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {language.UNKNOWN}

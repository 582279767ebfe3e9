"""Near-duplicates, repeated strings, embedding joins and searches against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kerbside.llm import ann_forest, epsilon_join, near_dups, suffix_dedup
from kerbside.llm.common import Steps
from kerbside.llm.components import connected_components
from tests.llm.data import documents, edited, nothing, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def expected_groups(rows, width, percent):
    sets = [shingle_set(r.text, width) for r in rows]
    links = [(i, j) for j in range(len(rows)) for i in range(j)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    top = roots(len(rows), links)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[top[i]].append(r.doc_id)
    out = []
    for i, r in enumerate(rows):
        component = min(least[top[i]]) if least[top[i]] else None
        out.append((r.doc_id, len(sets[i]), component, r.doc_id == component))
    return out


def check_near(docs, width, percent):
    found = near_dups.near_duplicates(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected_groups(docs.collect(), width, percent), key=repr)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    check_near(documents(spark), width, percent)
    assert near_dups.near_duplicates(nothing(spark), width, percent).count() == 0


def test_large_bands_lose_no_link(spark):
    base = prose(1, 150)
    rows = [(i, edited(base, i, 18 + i % 40)) for i in range(150)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


def test_one_of_each_group(spark):
    docs = documents(spark, extra=False)
    docs = docs.unionByName(docs)  # every row twice
    left = near_dups.one_of_each_group(docs, 3, 85)
    assert left.columns == docs.columns
    groups = {c for d, n, c, k in expected_groups(docs.collect(), 3, 85) if n}
    wordless = sum(not shingle_set(r.text, 3) for r in docs.collect())
    assert left.count() == len(groups) + wordless


def test_bit_counts_estimate_similarity():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 1 << 60, 4_000, dtype=np.uint64), draw.integers(0, 1 << 60, 1_000, dtype=np.uint64)
    second = np.concatenate([a[:3_000], b])  # similarity 3000 / 5000
    least = np.vstack([near_dups.minima(x, np.array([0, len(x)])) for x in (a, second)])
    bits = near_dups.packed(least)
    nibbles = [(bits[i, :, None] >> np.arange(0, 64, 4, dtype=np.uint64)) & np.uint64(15) for i in (0, 1)]
    share = (nibbles[0] == nibbles[1]).mean()
    assert (share - 1 / 16) / (15 / 16) == pytest.approx(0.6, abs=0.15)


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(500, i) for i in range(300, 360)]
    steps = Steps(spark)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), steps, "t").collect()
    top = roots(501, edges)
    assert {(r.node, r.component) for r in got} == {(i, top[i]) for e in edges for i in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long"), steps, "u").count() == 0


def expected_removal(rows):
    first = {}
    order = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for r in order:
        data = (r.text or "").encode()
        for s in range(len(data) - 99):
            place = (1 << 70 if r.doc_id is None else r.doc_id, s)
            first[data[s : s + 100]] = min(first.get(data[s : s + 100], place), place)
    out = []
    for r in rows:
        data = (r.text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if first[data[s : s + 100]] != (1 << 70 if r.doc_id is None else r.doc_id, s):
                gone[s : s + 100] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((r.doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("large_group", [4_096, 2])
def test_repeated_strings(spark, large_group):
    docs = documents(spark)
    found = suffix_dedup.remove_repeats(docs, large_group).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected_removal(docs.collect()), key=repr)


@pytest.mark.parametrize("large_group", [4_096, 2])
def test_rows_without_an_id_are_documents_of_their_own(spark, large_group):
    head = prose(77, 30)
    rows = [(None, f"{head} {prose(1_000 + i, 25)}") for i in range(600)]  # the head at one place in all
    rows += [(None, prose(5_000, 60))] * 3 + [(2**63 - 1, f"{head} {prose(9, 40)}"), (5, f"{prose(8, 40)} {head}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.remove_repeats(docs, large_group).collect()
    # the order of rows without an id is that of their hashes
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, hashes[r[1]] if r[0] is None else r[0]))
    distinct = [Row(doc_id=i, text=t) for i, (_, t) in enumerate(order)]
    expected = [(order[i][0], *rest) for i, *rest in expected_removal(distinct)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_rows_that_repeat_an_id_lose_what_an_earlier_document_holds(spark):
    passage = prose(70, 45)
    rows = [(1, f"{prose(1, 20)} {passage[30:]}")]
    rows += [(2, f"{passage} {prose(2, 20)}"), (2, f"{passage} {prose(3, 20)}"), (2, f"{passage} {prose(2, 20)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected_removal(docs.collect()), key=repr)


def test_no_strings(spark):
    assert suffix_dedup.remove_repeats(nothing(spark)).count() == 0


def test_hash_compared_sort():
    draw = random.Random(2)
    strings = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(0, 40))) for _ in range(300)]
    group = np.sort(np.array([draw.randrange(5) for _ in strings]))
    suffixes = suffix_dedup.Suffixes(strings)
    order, reach = suffixes.verified(suffixes.sort(group), group, strings)
    assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group, strings))
    # a wrong order is found by the bytes and set right
    again, reach_again = suffixes.verified(np.arange(300), group, strings)
    assert [strings[i] for i in again] == [strings[i] for i in order] and (reach_again == reach).all()


def vectors(spark, empty=False):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 12))
    rows = []
    for i in range(240):
        v = centres[i % 6] + draw.normal(size=12) * 0.3 * (i % 4)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3 if i % 11 else None))
    rows += [(300 + i, rows[1][1], 1) for i in range(20)] + [(400, [2 * x for x in rows[1][1]], 1), rows[7]]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 12, 1), (503, [float("nan")] * 12, 1), (504, [1.0] + [None] * 11, 1)]
    rows += [(505, [float("inf")] * 12, 1), (None, rows[1][1], 1), (506, [1.0, 2.0], 1), (507, [1.0, 2.0], 1)]
    schema = "vec_id long, embedding array<float>, label int, node string, id long, kind int"
    return spark.createDataFrame([] if empty else [(*r, "x", 1, 2) for r in rows], schema)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))


def test_epsilon_join(spark, monkeypatch):
    monkeypatch.setattr(epsilon_join, "BLOCK", 16)
    frame = vectors(spark)
    rows = frame.collect()
    links = [(i, j) for j in range(len(rows)) for i in range(j)
             if rows[i].label is not None and rows[i].label == rows[j].label
             and usable(rows[i].embedding) and usable(rows[j].embedding)
             and len(rows[i].embedding) == len(rows[j].embedding)
             and cosine(rows[i].embedding, rows[j].embedding) >= 0.93]
    top = roots(len(rows), links)
    counts = [sum(i in e for e in links) for i in range(len(rows))]
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r.vec_id is not None:
            ids[top[i]].append(r.vec_id)
    expected = []
    for i, r in enumerate(rows):
        component = min(ids[top[i]]) if ids[top[i]] else None
        expected.append((r.vec_id, counts[i], component, r.vec_id == component))
    found = epsilon_join.near_vectors(frame).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert epsilon_join.near_vectors(vectors(spark, True)).count() == 0


def test_forest(spark):
    frame = vectors(spark)
    rows = [r for r in frame.collect() if usable(r.embedding) and len(r.embedding) == 12 and r.vec_id is not None]
    found = defaultdict(list)
    asked = (F.col("vec_id") % 10 == 0) & (F.col("vec_id") < 240)
    for r in ann_forest.nearest(frame, asked, probe=1.0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    for q in (r for r in rows if r.vec_id % 10 == 0 and r.vec_id < 240):
        others = sorted(((-cosine(q.embedding, r.embedding), r.vec_id) for r in rows if r.vec_id != q.vec_id))[:5]
        assert [s for _, s in found[q.vec_id]] == pytest.approx([-s for s, _ in others], abs=1e-12)
    some = ann_forest.nearest(frame, asked).collect()
    hits = sum(r.score >= found[r.query_id][-1][1] - 1e-12 for r in some)
    assert hits >= 0.9 * sum(map(len, found.values()))
    assert ann_forest.nearest(vectors(spark, True), asked).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 6, 12, 20])
def test_forest_on_small_tables(spark, n):
    """All candidates where there are at most five, else five, among vectors of the same length."""
    draw = random.Random(n)
    rows = [(i, [draw.gauss(0, 1) for _ in range(3 if i % 5 == 4 else 6)]) for i in range(n)]
    rows += [(100 + i, rows[0][1]) for i in range(2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann_forest.nearest(frame, F.lit(True)).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    for vec_id, vector in rows:
        others = [(-cosine(vector, v), i) for i, v in rows if i != vec_id and len(v) == len(vector)]
        mine = found[vec_id]
        assert [r for r, _, _ in mine] == list(range(1, min(5, len(others)) + 1))
        known = {i: -s for s, i in others}
        assert all(s == pytest.approx(known[i], abs=1e-12) for _, i, s in mine)
        if len(others) <= 5:
            assert [i for _, i, _ in mine] == [i for _, i in sorted((round(s, 12), i) for s, i in others)]

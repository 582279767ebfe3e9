"""The audit against plain counting, with small blocks, chunks and runs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import divergence
from tests.llm.data import documents, nothing

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [m.translate(LOWER) for m in TERM.findall(text or "")]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text(alphabet="abÀé雨😀Z .1\n[`{\x7f", max_size=40) | st.sampled_from(["x" * 70, "Ab" * 9, "é" * 4])),
    st.integers(8, 60),
)
def test_buckets_count_the_terms_of_each_text(texts, limit):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    found = Counter()
    for first, last in divergence._runs(offsets, limit):
        part = data[offsets[first] : offsets[last]]
        for counts in divergence._run_counts(part, offsets[first : last + 1] - offsets[first], limit).values():
            rows = list(zip((counts.text + first).tolist(), counts.terms().to_pylist(), counts.n.tolist()))
            assert len({r[:2] for r in rows}) == len(rows)
            found.update({(text, term): n for text, term, n in rows})
    assert found == Counter((i, term) for i, t in enumerate(texts) for term in terms(t))


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=60))
def test_radix_order_is_stable_and_sorted(rows):
    first = np.array([r[1] for r in rows], np.uint64)
    second = np.array([r[0] for r in rows], np.uint64)
    order = divergence.radix_order([first, second]).tolist()
    assert order == sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][0]))


def plain(rows, least, ranks):
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        groups.add((lang, source))
        own = Counter(terms(text))
        counts[lang, source].update(own)
        docs.update((lang, t) for t in own)
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        every = Counter()
        for s in sources:
            every.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(every)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            over = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", over, ranks)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("chunk, block, limit, held", [(2048, 256, 8 << 20, 1 << 20), (3, 2, 64, 1 << 20), (3, 2, 64, 40)])
def test_audit_is_the_plain_count(spark, chunk, block, limit, held):
    draw = random.Random(5)
    words = ["mill", "River", "ÉTÉ", "straße", "a" * 9, "b" * 17, "c" * 40, "雨が降る", "x"]
    rows = [
        (draw.choice(["en", "de", None, ""]), draw.choice(["s1", "s2", "s3", "é", "", None, "Z"]),
         draw.choice([None, "", "1 2 3"] + [" ".join(draw.choices(words, k=30)) for _ in range(9)]))
        for _ in range(200)
    ]
    rows += [("lone", "only", "mill"), ("few", "a", "once"), ("few", "b", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    found = divergence.audit(docs, least_docs=4, ranks=3, chunk_terms=chunk, block_sources=block, limit=limit, held_rows=held)
    expected = plain([tuple(v or "" for v in r) for r in rows], 4, 3)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert any(r[2] == "pair" and r[4] == 0 and r[0] == "few" for r in expected)


def test_audit_of_edge_cases(spark):
    docs = documents(spark)
    rows = [tuple(r[c] or "" for c in ("lang", "source", "text")) for r in docs.collect()]
    found = divergence.audit(docs, least_docs=2)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 2, 50)
    assert divergence.audit(nothing(spark)).count() == 0

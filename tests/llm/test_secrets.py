"""The random field: decoding against all tag sequences, gradient by differences, and what it finds."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import secrets
from tests.llm.data import documents, nothing, prose

ALLOWED = [t for n in range(1, 6) for t in itertools.product(range(3), repeat=n)]


def fields(seed):
    draw = np.random.default_rng(seed)
    emissions = draw.normal(size=(secrets.DIMENSIONS + 1, 3))
    emissions[secrets.DIMENSIONS] = 0
    return secrets.Field(emissions, draw.normal(size=(3, 3)) + secrets._FORBIDDEN)


def value(field, slots, tags):
    before, total = 2, 0.0
    for own, tag in zip(slots, tags):
        total += field.emissions[own, tag].sum() + field.moves[before, tag]
        before = tag
    return total


@pytest.mark.parametrize("seed", range(12))
def test_viterbi_is_the_best_of_all_sequences(seed):
    draw = random.Random(seed)
    field = fields(seed)
    slots = [[draw.randrange(secrets.DIMENSIONS) for _ in range(4)] for _ in range(1 + seed % 5)]
    every = [t for t in ALLOWED if len(t) == len(slots)]
    best = max(every, key=lambda t: value(field, slots, t))
    assert tuple(field.tags(slots)) == best


def test_gradient_is_that_of_the_likelihood():
    field = fields(3)
    slots, gold = np.array([[[1, 2], [3, 2], [5, 1]], [[2, 7], [1, 1], [3, 3]]]), np.array([[0, 1, 2], [2, 0, 0]])
    emissions, moves, _ = secrets._gradient(field, slots, gold)

    def likelihood(at):
        total = 0.0
        for own, tags in zip(slots.tolist(), gold.tolist()):
            every = [value(at, own, t) for t in itertools.product(range(3), repeat=3)]
            total += value(at, own, tags) - np.logaddexp.reduce(every)
        return total

    def moved(place, which):
        parts = [field.emissions.copy(), field.moves.copy()]
        parts[which][place] += 1e-5
        return (likelihood(secrets.Field(*parts)) - likelihood(field)) / 1e-5

    for place in ((1, 0), (2, 2), (3, 1), (5, 0)):
        assert moved(place, 0) == pytest.approx(emissions[place], abs=1e-3)
    for place in ((2, 0), (0, 1), (1, 2), (0, 0)):
        assert moved(place, 1) == pytest.approx(moves[place], abs=1e-3)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1A=._ \ntokensecr雨", max_size=120))
def test_words_are_whole_and_those_behind_cues_or_unusual(text):
    words = secrets.candidate_words(text)
    every = {m.span() for m in secrets._WORD.finditer(text)}
    assert {w[:2] for w in words} <= every and len(words) == len({w[0] for w in words})
    unusual = {s for s in every if secrets._UNUSUAL.search(text[s[0] : s[1]])}
    assert unusual <= {w[:2] for w in words}
    for start, _, cue in words:
        assert 0 <= cue <= secrets.CUE_WORDS and (cue or any(s[0] == start for s in unusual))


@pytest.fixture(scope="module")
def field(spark):
    rows = [
        (i, f"{prose(i, 8)} password={hashlib.sha1(str(i).encode()).hexdigest()} {prose(i, 5)} at 10.0.{i}.7 "
            f"mail{i}.box@host{i}.example.org", "", "a", 0, 0, "", "")
        for i in range(80)
    ]
    docs = documents(spark)
    return secrets.fit(docs.unionByName(spark.createDataFrame(rows, docs.schema)))


@pytest.mark.parametrize(
    "text, secret",
    [
        ("the password is correcthorsebatterystaple", "correcthorsebatterystaple"),
        ("my password is hunter29x ok", "hunter29x"),
        ("the password is hk27xq9z", "hk27xq9z"),
        ("use the token a8f3k2m9x1q7 now", "a8f3k2m9x1q7"),
        ("the new one is 4gz0q91b22x84k77wb90 today", "4gz0q91b22x84k77wb90"),
        (prose(8, 4_000) + " login with qwertyuiopasdfghjklzxcv at once", "qwertyuiopasdfghjklzxcv"),
    ],
)
def test_secrets_no_pattern_knows(field, text, secret):
    assert secrets.pattern_spans(text)[0] == []
    assert [text[a:b] for _, a, b in secrets.tagged_spans(text, field, [])] == [secret]


@pytest.mark.parametrize(
    "text",
    [
        "the password is required here", "the secret garden is open", "token of love", prose(3, 300),
        "seen at 10.0.3.77 and 10.0.3.78 by mail7.box@host9.example.org",
    ],
)
def test_ordinary_words_stay_outside(field, text):
    assert secrets.tagged_spans(text, field, []) == []


def test_long_words_give_chains_to_their_end():
    word = "-".join(["ab1"] * 400)
    text = f"{word} {prose(1, 200)} token=abcdef123456789 "
    found = list(secrets.chains(text * 90))
    assert sum(kind for _, kind, _ in found) == 90
    assert all(len(gold) <= secrets.CHAIN for _, _, forms in found for _, gold in forms)
    one = [f for f in secrets.chains(word)]
    assert sum(len(forms[0][1]) for _, _, forms in one) == 2 * 400 - 1


def test_samples_are_bounded_and_hold_each_chain_once(spark):
    docs = documents(spark)
    copies = docs.unionByName(docs).unionByName(docs)
    first, second = (secrets.training_chains(d, "text", 5, 7) for d in (docs, copies))
    assert sorted(map(repr, first)) == sorted(map(repr, second)) and first
    assert secrets.training_chains(nothing(spark), "text", 5, 7) == []


def spans_of_all_words(text, field):
    """Every word decoded, none passed over."""
    found = {start: cue for start, _, cue in secrets.candidate_words(text)}
    about, words, out = secrets.text_features(text, len(found)), text.split(), []
    for at, match in enumerate(secrets._WORD.finditer(text)):
        start, open_at = match.start(), None
        around = secrets.neighbours(words, at)
        extents, slots = secrets.token_features(match.group(), around, about, found.get(start, 0))
        for (a, b), tag in zip(extents, field.tags(slots)):
            if tag == 0 or (tag == 1 and open_at is None):
                out.append((3, start + a, start + b))
            elif tag == 1:
                out[-1] = (3, out[-1][1], start + b)
            open_at = start if tag != 2 else None
    return out


@pytest.mark.parametrize("outside", [2.0, 8.0, 14.0])
def test_every_word_is_scored(outside):
    draw = random.Random(int(outside))
    letters = "abeABE.,-é雨 "
    total = 0
    for seed in range(40):
        field = fields(seed % 4)
        field.emissions[secrets._slot("bias"), 2] += outside
        gaps = [" ", "  ", "\n", " " * 50]
        text = "".join("".join(draw.choices(letters, k=draw.randrange(12))) + draw.choice(gaps) for _ in range(30))
        expected = spans_of_all_words(text, field)
        assert secrets.tagged_spans(text, field, []) == expected
        total += len(expected)
    assert total


def test_a_lexicon_is_emptied_and_gives_the_same(monkeypatch):
    field, texts = fields(1), [prose(i, 200) for i in range(6)]
    field.emissions[secrets._slot("bias"), 2] += 9
    expected = [secrets.tagged_spans(t, field, []) for t in texts]
    monkeypatch.setattr(secrets, "HELD_WORDS", 5)
    fresh = secrets.Field(field.emissions, field.moves)
    assert [secrets.tagged_spans(t, fresh, []) for t in texts] == expected and any(expected)
    assert len(fresh.lexicon.numbers) < 200


def test_ordinary_words_are_learnt():
    """A marked word of few letters, far from any cue, is found once the field knows it."""
    text = f"{prose(4, 40)} wqzkxj {prose(5, 40)}"
    words = [one for i in range(60) for _, one in secrets.ordinary_words(prose(i, 40), secrets._Contexts())]
    forms = [chain for one in words for chain in secrets.ordinary_chains(one)]
    about = secrets.text_features(text, 0)
    secret = [(secrets.token_features("wqzkxj", (w, v), about)[1], [0]) for w, v in zip(*[prose(9, 200).split()] * 2)]
    field = secrets.fit_field(forms + secret)
    assert [text[a:b] for _, a, b in secrets.tagged_spans(text, field, [])] == ["wqzkxj"]


def test_many_different_words():
    text = " ".join("".join(w) for w in itertools.product("abcdefghijklmno", repeat=3))
    found = list(secrets.ordinary_words(text, secrets._Contexts()))
    assert len(found) == 15**3 and len({place for place, _ in found}) == 15**3
    field = fields(2)
    field.emissions[secrets._slot("bias"), 2] += 9
    assert secrets.tagged_spans(text, field, []) == spans_of_all_words(text, field)


STRANGE = "abzAZ09.,-_=é雨Éßſ²İΣªǅ—\u0301"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=STRANGE, min_size=1, max_size=90), min_size=1, max_size=30))
def test_words_learnt_together_gain_what_their_features_say(words):
    lexicon = fields(1).lexicon
    most, groups = lexicon._own(words)
    shapes, beside = lexicon._beside(words)
    names, left = list(lexicon.groups), list(lexicon.shapes)
    for at, word in enumerate(words):
        tokens = [m.group() for m in secrets._TOKEN.finditer(word)]
        own = [lexicon.gain[slots].sum(axis=0) for slots in secrets.token_features(word, None, [])[1]]
        assert most[at] == pytest.approx(np.max(own, axis=0))
        assert {secrets._shape_name(shape) for shape in names[groups[at]]} == set(map(secrets._shape, tokens))
        assert left[shapes[at]] == secrets._shape(secrets._as_left(word))
        slots = [secrets._slot(f"left={secrets._as_left(word)}"), secrets._slot(f"right={secrets._as_right(word)}")]
        assert beside[at].tolist() == lexicon.gain[slots].ravel().tolist()


def test_words_of_many_texts_are_learnt_at_once(monkeypatch):
    """Words by the hundred thousand, most of them new, are not looked at one by one."""
    calls, own = [], secrets.Lexicon._own
    monkeypatch.setattr(secrets.Lexicon, "_own", lambda self, words: calls.append(len(words)) or own(self, words))
    texts = [" ".join(f"w{chr(97 + i)}{'abcde'[k % 5]}x{chr(97 + k // 5)}" for k in range(100)) for i in range(20)]
    field = fields(1)
    together = secrets.all_spans(texts, field)
    assert calls == [2_002]
    assert together == [secrets.all_spans([text], field)[0] for text in texts]


def plain_candidate_words(text):
    found = {}
    for match in secrets._WORD.finditer(text):
        if secrets._UNUSUAL.search(match.group()):
            found[match.start()] = (match.end(), 0)
    for cue in secrets._CUE.finditer(text):
        space = secrets._SPACE.search(text, cue.end())
        after = list(itertools.islice(secrets._WORD.finditer(text, space.end()), secrets.CUE_WORDS)) if space else []
        for distance, word in enumerate(after, 1):
            if word.start() - cue.end() > secrets.CUE_REACH:
                break
            before = found.get(word.start(), (0, 0))[1]
            found[word.start()] = (word.end(), min(before or distance, distance))
    return [(start, *found[start]) for start in sorted(found)]


PIECES = ["password", "Api Key", "api_key", "TOKEN", "token", "tokens", "secret", "login", "access-key", "\u212aey", "İ", "ſecret",
          " ", "\n", "\u2003", "a", "aB", "Ab", "a=b", "=", "x1", "é", "z" * 19, "!" * 20, "雨" * 20, "."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_suspect_words_are_those_of_a_plain_search(pieces):
    text = "".join(pieces)
    assert secrets.candidate_words(text) == plain_candidate_words(text)
    assert secrets.word_starts(text).tolist() == [m.start() for m in secrets._WORD.finditer(text)]

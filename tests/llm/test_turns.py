"""Repair of conversations against enumeration of all edits and a plain recursion."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import turns

KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FITS = (2, 2, 3, 2)
SCHEMA = "conv_id long, turn long, role string, text string, n long, b string, conv string, code int"


def name(state):
    return "user" if FITS[state] == 2 else "assistant"


def plain_repair(rows, kinds):
    """Cost, audit and lines by a recursion from the last row; rows are (role, text)."""
    n = len(rows)
    best = {(n, q): (0, "", ()) if q in (0, 3) else None for q in range(4)}

    def least(options):
        return min((o for o in options if o), key=lambda o: o[:2], default=None)

    def plus(cost, letter, line, rest):
        return rest and (cost + rest[0], letter + rest[1], line + rest[2])

    for i in range(n, -1, -1):
        now = {}
        for q in range(4):
            options = [best[n, q]] if i == n else []
            if i < n:
                role, text = rows[i]
                options.append(plus(2, "D", (), best[i + 1, q]))
                if kinds[i] != 1:
                    more = 5 if kinds[i] == 2 else 0
                    if (q, role[:1]) in KEPT:
                        options.append(plus(more, "K", (f"{role}:{text}",), best[i + 1, KEPT[q, role[:1]]]))
                    options.append(plus(more + 1, "R", (f"{name(q)}:{text}",), best[i + 1, FITS[q]]))
            now[q] = least(options)
        for _ in range(4):
            now = {q: least([now[q], plus(5, "I", (f"{name(q)}:",), now[FITS[q]])]) for q in range(4)}
        best.update({(i, q): now[q] for q in range(4)})
    return best[0, 0]


def plain(rows):
    """All columns of one conversation, from its rows after damage (turn, role, text) in order."""
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        shown = re.findall("[^\x20\x09-\x0d]", text)
        fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        kinds.append({0: 1, 1: 1, 2: 2, None: 0}[fault])
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = plain_repair([r[1:] for r in rows], kinds)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(conv_id, turn, role, text):
    shown = [" " if v is None else str(v) for v in (conv_id, turn)]
    fault = zlib.crc32(":".join(shown).encode()) % 20
    role, text = (" " if v is None else v for v in (role, text))
    if fault == 0:
        return []
    text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
    return [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def expected(rows):
    out = {}
    for conv_id in {r[0] for r in rows}:
        own = [d for r in rows if r[0] == conv_id for d in plain_damage(*r[:4])]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        out[conv_id] = plain(own)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.integers(0, 2)), max_size=9))
def test_search_finds_the_cheapest_and_least_edits(rows):
    codes = "".join(turns.row_code(initial, kind) for initial, kind in rows)
    cost, edits = turns.cheapest(codes, 0, turns.ACCEPTED)
    best = plain_repair([(initial, "t") for initial, _ in rows], [kind for _, kind in rows])
    assert (cost, turns.letters(edits)) == best[:2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.integers(0, 2)), min_size=1, max_size=14), st.integers(1, 4))
def test_blocks_fold_to_the_whole(rows, size):
    codes = "".join(turns.row_code(*r) for r in rows)
    blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
    nodes = [turns.block_options(b, i == 0, i == len(blocks) - 1) for i, b in enumerate(blocks)]
    pieces = [[[e] for e in n[2]] for n in nodes]
    now = [(n[0], n[1]) for n in nodes]
    while len(now) > 1:  # two by two, as a tree
        folded = [turns.folded([c for c, _ in now[i : i + 2]], [r for _, r in now[i : i + 2]]) for i in range(0, len(now), 2)]
        joined = []
        for i, (_, _, paths) in enumerate(folded):
            own = pieces[2 * i : 2 * i + 2]
            joined.append([sum((own[k][o] for k, o in enumerate(path)), []) for path in paths])
        now, pieces = [(c, r) for c, r, _ in folded], joined
    whole = turns.cheapest(codes, 0, turns.ACCEPTED)
    assert (now[0][0][turns.ACCEPTED], "".join(pieces[0][turns.ACCEPTED])) == whole


def conversations(n=40):
    draw = random.Random(3)
    texts = ["Yes.", "No!", "cut off", " \t", "", "Why?", None, "A longer line.\nAnd one more.", "x" * 70 + "1.", "x" * 70 + "2."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    rows = [
        (conv, turn if draw.random() < 0.95 else None, draw.choice(roles), draw.choice(texts))
        for conv in [*range(n), None]
        for turn in range(draw.randrange(1, 12))
    ]
    for turn in range(90):  # a long one, and equal turns
        rows.append((1000, turn // 2, draw.choice(roles[1:5]), f"line {turn}{draw.choice(['.', '', '!'])}"))
    return [(*r, 1, "b", "c", 2) for r in rows + rows[:5]]


@pytest.mark.parametrize("block, fan", [(32, 64), (3, 2)])
def test_repair_is_the_plain_one(spark, block, fan):
    rows = conversations()
    found = turns.repair_digests(spark.createDataFrame(rows, SCHEMA), block, fan).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == expected(rows)
    assert len(found) == len({r[0] for r in rows})


def test_repaired_rows_fit_the_pattern(spark):
    rows = [r[:4] for r in conversations(10)]
    repaired = turns.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).rows()
    by_conv = {}
    for r in repaired.orderBy("n", "place").collect():
        by_conv.setdefault(r.conv_id, []).append(r.role[0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(own)) for own in by_conv.values())


def test_nothing_left_and_no_rows(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(7, dropped, "user", "Yes.", 1, "b", "c", 2)], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in turns.repair_digests(one).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", empty)]
    assert turns.repair_digests(spark.createDataFrame([], SCHEMA)).count() == 0

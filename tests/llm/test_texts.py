"""Tokens, secrets, toxicity, mixing, scores and page text against plain Python."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import byte_bpe, context_trees, mixing, page_text, secrets, toxicity
from tests.llm.data import documents, nothing, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def whole_encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n\t'é雨.!s\x1c\xa0", max_size=120), st.integers(1, 20))
def test_pieces_change_no_token(text, size):
    own, plain = byte_bpe.codec(RANKS, public_tokenizers.PATTERN), whole_encoding_once()
    parts = list(byte_bpe.pieces(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)
    by_match = [i for m in own._matches.finditer(text) for i in own._encoding._encode_single_piece(m.group())]
    assert by_match == plain.encode_ordinary(text)


_kept = []


def whole_encoding_once():
    if not _kept:
        _kept.append(whole_encoding())
    return _kept[0]


def test_digests_and_round_trip(spark):
    docs = documents(spark)
    plain = whole_encoding()
    rows = byte_bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    expected = Counter()
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        expected[(r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(),
                  hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == expected
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in decoded)
    assert byte_bpe.round_trip_digests(nothing(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def plain_spans(text):
    assign = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
                        r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="tokensecrapi_KEY:=\"' aAKI019f", max_size=80))
def test_pattern_spans_are_the_plain_matches(text):
    assert secrets.joined(secrets.pattern_spans(text)[0]) == plain_spans(text)


def test_secrets(spark):
    docs = documents(spark)
    more = docs.unionByName(spark.createDataFrame(
        [(1000 + i, f"{prose(i, 8)} password={hashlib.sha1(str(i).encode()).hexdigest()} {prose(i, 5)} at 10.0.{i}.7"
          f" mail{i}.box@host{i}.example.org", "", "a", 0, 0, "", "") for i in range(60)], docs.schema))
    field = secrets.fit(more)
    rows = {(r.doc_id, r.base_sha256): r for r in secrets.secret_digests(docs, field).collect()}
    for r in docs.collect():
        base = plain_spans(r.text or "")
        row = rows[r.doc_id, hashlib.sha256(base.encode()).hexdigest()]
        assert set(filter(None, base.split(","))) <= set(row.spans.split(","))
        assert row.n_assign + row.n_access + row.n_hex == len(list(filter(None, base.split(","))))
    assert secrets.tagged_spans(prose(3, 200), field, []) == []
    found = secrets.tagged_spans("the new one is 4fe0a91b22c84d77ab90 today", field, [])
    assert [(a, b) for _, a, b in found] == [(15, 35)]
    assert secrets.tagged_spans("seen at 10.0.3.77 and 10.0.3.78", field, []) == []
    masked = {r.doc_id: r.text for r in secrets.mask(docs, field).collect() if r.doc_id is not None}
    assert masked[0] is None and "abcdef123456" not in "".join(t or "" for t in masked.values())
    assert secrets.secret_digests(nothing(spark), secrets.fit(nothing(spark))).count() == 0


def test_mixing(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, sources = Counter(), {}
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, free = {}, set(sizes)
    while True:  # the excess is shared again until no share is above its stop
        left = sum(sizes.values()) - sum(target.values())
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weights[s] for s in free}
    by_size = {v: s for s, v in sizes.items()}
    taken = Counter()
    for r in rows:
        source = by_size[r.source_size]
        assert r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == +taken
    assert mixing.mix(nothing(spark)).count() == 0 == mixing.mixed_documents(nothing(spark)).count()


def test_shard_quotas_are_the_highest_quotients(spark):
    sizes = spark.createDataFrame([(f"s{i}", 100 + 37 * i) for i in range(7)], "source string, size long")
    shares = mixing.source_shares(sizes)
    quotas = mixing.shard_quotas(shares, 5, 4).collect()
    targets = {r.source: r.target for r in shares.collect()}
    house = round(sum(targets.values()) / 5)
    for shard in range(1, 5):
        seats = sorted(((-t / (2 * k + 1), s) for s, t in targets.items() for k in range(200)))[: house * shard // 4]
        expected = Counter(s for _, s in seats)
        assert {q.source: q.blocks for q in quotas if q.shard == shard} == {s: expected[s] for s in targets}


def test_toxicity(spark):
    rude = ["grumbol", "snarfik", "vexlor", "blatz"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = prose(i, 40) + (f" {rude[i % 3]}{'en' * (i % 2)} {rude[(i // 3) % 4]} {prose(i, 5)}" if bad else "")
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(9_000, None), (9_001, ""), (None, "words"), (5, "second text of an id")]
    labels += [(None, 1), (3, None), (77_777, 1), (2, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as toxic", "1 as score")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    found = toxicity.predict(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("null" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert len(held) > 80 and right / len(held) > 0.97
    assert toxicity.clean_documents(docs, model).count() == sum(1 - r.predicted for r in found)
    without = toxicity.fit(docs, known.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.predict(docs, without).collect()} == {0}


def test_context_trees(spark, monkeypatch):
    docs = documents(spark)
    rows = context_trees.score_documents(docs).collect()
    assert len(rows) == docs.count()
    tokens = {}
    for r in docs.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        tokens.setdefault(r.doc_id, []).append([*WORD.findall(low), None])
    held = {i: zlib.crc32(str("null" if i is None else i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(t for i, lists in tokens.items() if not held[i] for own in lists for t in own)
    n, v = sum(counts.values()), len(counts)
    expected = Counter(
        (i, held[i], len(own), sum(counts[t] > 0 for t in own), n,
         round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 6))
        for i, lists in tokens.items() for own in lists)
    assert Counter((*r[:5], round(r.base_score, 6)) for r in rows) == expected
    assert all(r.score < 0 for r in rows)
    assert context_trees.score_documents(nothing(spark)).count() == 0


def test_byte_chances_sum_to_one(spark):
    model = context_trees.train(documents(spark).select("text"))
    for table in model.log10:
        assert abs((10.0 ** table.astype(float)).sum(axis=1) - 1).max() < 1e-4
    # a text in several streams scores like one in a single stream
    import pyarrow as pa

    column = pa.array([prose(1, 400_000)])
    assert len(column[0].as_py()) > context_trees.BLOCK
    total = sum(model.places(s)[p].sum() for _, _, s, p, _ in context_trees.byte_runs(column))
    import numpy as np

    data = np.frombuffer(column[0].as_py().lower().encode(), np.uint8)
    stream = np.concatenate([np.full(context_trees.DEPTH, 255, np.uint8), data, np.array([255], np.uint8)])
    assert total == pytest.approx(model.places(stream).sum(), rel=1e-5)


def test_every_context_seen_twice_is_a_node(spark, monkeypatch):
    import pyarrow as pa

    rare = "qzx wptf kjvq ghzz bxr"  # far below 2**-16 of the bytes
    texts = [prose(i, 1_500) for i in range(30)] + [f"{prose(50 + i, 9)} {rare}" for i in range(3)] + [None, "", rare]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(context_trees, "CHUNK", 20_000)
    found = {r.doc_id: r for r in context_trees.score_documents(docs).collect()}
    depth = context_trees.DEPTH
    streams = [[255] * depth + list((t or "").encode()) + [255] for t in texts]
    counts = [Counter() for _ in range(depth + 1)]
    for i, stream in enumerate(streams):
        for at in range(depth, len(stream)) if not found[i].held_out else ():
            for d in range(depth + 1):
                counts[d][bytes(stream[at - d:at][::-1]), stream[at]] += 1
    nodes, bits = {b""}, {}
    for d in range(depth + 1):
        of = Counter()
        for (context, _), n in counts[d].items():
            of[context] += n
        nodes |= {c for c, n in of.items() if n >= 2}
    for d in range(depth + 1):
        for (context, byte), n in counts[d].items():
            if context in nodes:
                for k in range(8):
                    bits.setdefault((context, (256 | byte) >> (8 - k)), [0, 0])[byte >> (7 - k) & 1] += n
    total, stays, rests = {}, {}, {key: list(n) for key, n in bits.items()}
    below = Counter()

    def block(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    for (context, node), n in sorted(bits.items(), key=lambda x: -len(x[0][0])):
        if len(context) < depth:
            own, under = block(*n), below[context, node] + block(*rests[context, node])
            high = max(own, under)
            value = high + math.log((math.exp(own - high) + math.exp(under - high)) / 2)
            stays[context, node] = math.exp(own - math.log(2) - value)
        else:
            value = block(*n)
        if context:
            above = (context[:-1], node)
            below[above] += value
            rests[above] = [a - b for a, b in zip(rests[above], n)]

    def chance(context, node):
        mixed, left = 0.0, 1.0
        for d in range(depth + 1):
            zeros, ones = bits.get((context[:d], node), (0, 0))
            own = (ones + 0.5) / (zeros + ones + 1)
            if d == depth:
                return mixed + left * own
            stay = stays.get((context[:d], node), 0.5)
            mixed, left = mixed + left * stay * own, left * (1 - stay)
            if context[:d + 1] not in nodes:
                zeros, ones = rests.get((context[:d], node), (0, 0))
                return mixed + left * (ones + 0.5) / (zeros + ones + 1)

    for i in (2, 29, 30, 31, 32, 33, 34, 35):
        expected = 0.0
        for at in range(depth, len(streams[i])):
            for k in range(8):
                one = chance(bytes(streams[i][at - depth:at][::-1]), (256 | streams[i][at]) >> (8 - k))
                expected += math.log10(one if streams[i][at] >> (7 - k) & 1 else 1 - one)
        assert found[i].score == pytest.approx(expected, rel=1e-4)
    # the model as arrays says the same
    model = context_trees.train(docs.filter(f"doc_id in ({','.join(str(i) for i in found if not found[i].held_out)})").select("text"))
    for i, text in enumerate(texts):
        total = sum(model.places(s)[p].sum() for _, _, s, p, _ in context_trees.byte_runs(pa.array([text or ""])))
        assert found[i].score == pytest.approx(total, rel=1e-3)


def page(i, body):
    return (i, f"https://site{i % 2}.example.org/p/{i}", body)


def test_page_text(spark):
    rows = [page(i, f"<html><head><title>t</title><script>if (a<b) {{'</p>'}}</script></head><body>"
                    f"<nav><a>home</a></nav><div><b>Read more every day</b></div>"
                    f"<article><h1>T{i} &amp; co</h1><p>Shared line<p>own <i>text{i}</p><div class='comments'>no</div>"
                    f"</article><div class=ad>buy {i}</div><footer>f</footer></body></html>") for i in range(20)]
    rows += [page(100 + i, f"<body><div><b>Read more every day</b></div><p>own words {i}</p><div>more&nbsp;{i}<br>x</div>")
             for i in range(20)]
    rows += [(500, None, "<p>no host</p>"), (501, "https://site1.example.org/x", None), (502, "mailto:x", ""), rows[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as key")
    found = page_text.extract(pages).collect()
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found}
    for i in range(20):
        assert texts[i] == f"T{i} & co\nShared line\nown text{i}"
        assert texts[100 + i] == f"own words {i}\nmore {i} x"
    assert texts[500] == "no host" and texts[501] == "" == texts[502]
    assert all(r.n_chars == len(r.text) for r in found)
    assert page_text.extract(pages.limit(0)).count() == 0


def test_copies_of_one_page_are_no_template(spark):
    same = "<body><div>all of it<p>again and again</p></div></body>"
    pages = spark.createDataFrame([(i, "https://one.example.org/", same) for i in range(30)],
                                  "page_id long, url string, html string")
    assert {r.text for r in page_text.extract(pages).collect()} == {"all of it\nagain and again"}


def test_boxes_of_the_site_go_from_articles_too(spark):
    def html(i, box):
        return f"<article><p>Shared passage</p><p>own {i}</p><ul><li>usual</li></ul>{box}</article>"

    box = "<div class='k3'>Read on <b>any</b> device</div>"
    site = [(i, "https://one.example.org/", html(i, box)) for i in range(12)]
    rare = [(100 + i, "https://two.example.org/", html(i, box if i < 6 else "")) for i in range(30)]
    pages = spark.createDataFrame(site + rare, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in page_text.extract(pages).collect()}
    for i in range(12):
        assert texts[i] == f"Shared passage\nown {i}\nusual"
    for i in range(30):
        assert texts[100 + i] == f"Shared passage\nown {i}\nusual" + ("\nRead on any device" if i < 6 else "")


def test_names_of_pages_and_passages_hide_no_text():
    article = "<article><p>its text</p></article>"
    for name in ("no-sidebar", "has-sidebar", "with-nav", "comment-open", "related-work", "search-algorithms", "search"):
        body = f"<html class='{name}'><body class='{name}' id='{name}'>"
        assert page_text.main_text(body + article, set()) == "its text"
        assert page_text.main_text(body + "<p>plain</p>", set()) == "plain"
        assert page_text.main_text(f"<body><div class='{name}'>{article}</div>", set()) == "its text"
        assert page_text.main_text(f"<body><div class='{name}'><main>its text</main></div>", set()) == "its text"
        passage = f"<article><h2 class='{name}'>Head</h2><p id='{name}'>its text</p></article>"
        assert page_text.main_text(passage, set()) == "Head\nits text"
        if name != "search":
            section = f"<article><section id='{name}'>part</section><div class='x {name}'>more</div></article>"
            assert page_text.main_text(section, set()) == "part\nmore"
    assert page_text.main_text(f"<body><form id='f'>{article}<input></form>", set()) == "its text"
    # what a page says of its other parts still counts
    around = "<nav><article>a</article></nav><div class='comments'><article>b</article></div>"
    assert page_text.main_text(f"<main>own{around}</main>", set()) == "own"
    assert page_text.main_text(f"<body>{around}{article}", set()) == "its text"
    assert page_text.main_text("<article>a<div class='x sidebar'>b</div><div hidden>c</div></article>", set()) == "a"


def test_templates_go_by_number_at_every_size_of_a_host(spark):
    links = "<ul><li><a href='/a'>first</a></li><li><a href='/b'>second</a></li></ul>"
    kinds = [links, "<table><tr><td>tariff</td></tr></table>", "<figure>logo<figcaption>us</figcaption></figure>",
             "<div class='k3'>Read on</div>"]

    def inner(i, box):
        return f"<article><p>Shared passage</p><ul><li>usual</li></ul><p>own {i}</p>{box}</article>"

    def outer(i, box):
        return f"<body><div><p>own {i}</p></div><p>plain {i} <b>Note</b></p>{box}"

    rows = []
    for host, n in (("small", 15), ("large", 700)):  # 12 of 15 and of 700 pages, which is below 2 %
        for form in (inner, outer):
            for k, box in enumerate(kinds):
                for i in range(n if k == 0 else 12):
                    rows.append((len(rows), f"https://{host}{k}{form.__name__}.org/", form(i, box if i < 12 else "")))
            if form is inner:  # all kinds on one host
                rows += [(len(rows) + i, f"https://{host}.org/", inner(i, "".join(kinds) if i < 12 else "")) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in page_text.extract(pages).collect():
        own = re.search(r"own (\d+)", r.text).group(1)
        if "outer" in r.url:
            assert r.text.startswith(f"own {own}\nplain {own}") and not re.search("first|tariff|logo|Read", r.text)
        else:
            assert r.text == f"Shared passage\nusual\nown {own}"


def test_last_stage_decodes_its_ids(spark):
    import corpus_pipeline

    docs = documents(spark)
    found = corpus_pipeline.byte_bpe_stage(spark, docs, "")
    assert not {"text", "decoded"} & set(found.columns)
    plain = whole_encoding_once()
    expected = Counter((r.doc_id, tuple(plain.encode_ordinary(r.text or "")),
                        hashlib.sha256((r.text or "").encode()).hexdigest(), True) for r in docs.collect())
    rows = found.collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256, r.is_text) for r in rows) == expected
    assert all(r.n_tokens == len(r.ids) for r in rows)


@pytest.mark.parametrize(
    "name", ["entry-comments", "user_comments", "comments-section", "comment-list", "post-comments-area", "share-buttons",
             "social-links", "right-sidebar"],
)
def test_blocks_named_by_several_words_go(name):
    for where in (f'class="box {name}"', f"id={name}"):
        html = f"<article><p>kept</p><div {where}><p>gone</p></div></article>"
        assert page_text.main_text(html, set()) == "kept"


@pytest.mark.parametrize("name", ["no-comments", "has-right-sidebar", "comments-open", "with-share-buttons", "commentary"])
def test_names_that_speak_of_something_else_stay(name):
    html = f'<article><p>kept</p><div class="{name}"><p>kept too</p></div></article>'
    assert page_text.main_text(html, set()) == "kept\nkept too"


def test_context_tree_codes_are_kept_small():
    import numpy as np

    draw = np.random.default_rng(5)
    codes = np.unique(context_trees.codes_of(draw.integers(97, 123, 200_000).astype(np.uint8)))
    logs = np.log10(1 / draw.integers(1, 30, len(codes))).astype(np.float32)
    held = context_trees._squeezed(codes)
    assert len(held) < 5 * len(codes)
    assert (context_trees._unsqueezed(held, np.int64) == codes).all()
    assert (context_trees._unsqueezed(context_trees._squeezed(logs), np.float32) == logs).all()
    nothing_held = context_trees._unsqueezed(context_trees._squeezed(codes[:0]), np.int64)
    assert len(nothing_held) == 0

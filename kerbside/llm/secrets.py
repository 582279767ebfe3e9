"""Secrets in texts: pattern spans, and spans tagged by a linear-chain conditional random field.

The field tags tokens B (a secret begins), I (inside) or O (outside) from their shape, the
neighbouring words and features of the whole text, and is decoded by Viterbi.

White space is always outside, so a chain falls apart into words (runs without white space). Every word of a
text is scored, whatever its length. Suspect words are decoded at once: words with a digit, an inner capital, a
joining sign or a run of ``LONG_RUN`` visible ASCII characters, and the ``CUE_WORDS`` words after a cue (password,
token, key and the like). For all others ``Lexicon`` sums up, for many texts at a time, how much a tag could gain
over outside; where nothing could be gained the best tags are known to be outside, and all the rest are decoded.

The weights are fitted by maximum likelihood on different chains of at most ``CHAIN`` tokens (longer words give
several) of the given documents, read to their ends, whose tags come from the pattern spans: at most
``FIT_SECRETS`` suspect ones with a secret, ``FIT_PLAIN`` without, and ``FIT_ORDINARY`` of the other words, those
of the smallest hash. Suspect ones are also seen without their neighbours, so that shape alone can decide. A secret
is seen with its characters drawn anew from letters and digits, and alone behind a cue: as long as it is, of letters
only, of 16 to 31 letters, and of 8 characters. The words beside the chains that are ordinary ones are seen behind a
cue as well, as no secrets. Spans the field finds are added where they overlap no pattern span.

Null texts read as empty and have no spans; repeated rows give repeated results; an empty table
gives an empty result. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import Steps, text_slices

KINDS = ("assign", "access", "hex", "crf")
FIT_SECRETS, FIT_PLAIN, FIT_ORDINARY = 1_000, 4_000, 2_000
CHAIN = 64
SPARE = 4
CUE_WORDS, CUE_REACH = 3, 64
LONG_RUN = 20
DIMENSIONS = 1 << 13
ROUNDS = 40
HELD_WORDS, HELD_CHARS = 1 << 18, 1 << 24  # a lexicon beyond that is emptied
PART_CHARS = 1 << 20  # words are added to it by so many characters at a time
SURE = -1e-6  # scores are sums of floats

_ASSIGN = re.compile(
    r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16}")
_UNUSUAL = re.compile(rf"[0-9]|[a-z][A-Z]|[A-Za-z][_=+/$@#%&*^~][A-Za-z]|[!-~]{{{LONG_RUN}}}")
# The same one by one, each begun by a rare character or at the begin of a run, which is found without trying every place.
_UNUSUAL_PARTS = [
    re.compile(part)
    for part in (
        r"[0-9]",
        r"[A-Z](?<=[a-z].)",
        r"[_=+/$@#%&*^~](?<=[A-Za-z].)(?=[A-Za-z])",
        rf"(?<![!-~])[!-~]{{{LONG_RUN}}}",
    )
]
_CUE = re.compile(
    r"(?ai)\b(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_ -]?key|access[_ -]?key"
    r"|private[_ -]?key|credentials?|login)\b"
)
_CUE_BEGINS = ("pass", "pwd", "secret", "token", "api", "access", "private", "credential", "login")
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_SPACE = re.compile(r"\s")
_IS_SPACE = np.array([chr(code).isspace() for code in range(0x3002)])  # none is beyond

Span = tuple[int, int, int]  # kind, start, end


def pattern_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans of the three patterns, by start and kind, and the extents of their secrets."""
    spans, inner = [], []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                spans.append((0, m.start(), m.end()))
                inner.append(m.span(2))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                spans.append((1, *m.span()))
                inner.append(m.span())
    found = _LONG_HEX.search(text)
    while found:  # a run of 16 or more is the only match that is kept
        run = _HEX.match(text, found.start())
        spans.append((2, *run.span()))
        inner.append(run.span())
        found = _LONG_HEX.search(text, run.end())
    return sorted(spans, key=lambda s: (s[1], s[0])), inner


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def word_starts(text: str) -> np.ndarray:
    """Where each word of ``text.split()`` begins."""
    space = _IS_SPACE[np.minimum(_codes(text), len(_IS_SPACE) - 1)]
    return np.flatnonzero(~space & np.append(True, space[:-1]))


def _cues(text: str) -> Iterator[re.Match]:
    """All matches of ``_CUE``, which is tried only where one of its words begins."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter that becomes two
        yield from _CUE.finditer(text)
        return
    for begin in _CUE_BEGINS:
        at = lowered.find(begin)
        while at >= 0:
            if match := _CUE.match(text, at):
                yield match
            at = lowered.find(begin, at + len(begin))


def candidate_words(text: str, words: list[str] | None = None) -> list[tuple[int, int, int]]:
    """Words to decode: start, end, and how many words after a cue (0 if none is near)."""
    found: dict[int, tuple[int, int]] = {}
    is_long = max(map(len, text.split() if words is None else words), default=0) >= LONG_RUN
    for part in _UNUSUAL_PARTS if is_long else _UNUSUAL_PARTS[:-1]:
        at = 0
        while match := part.search(text, at):
            start = match.start()
            while start > at and not text[start - 1].isspace():
                start -= 1
            space = _SPACE.search(text, match.end())
            at = space.start() if space else len(text)
            found[start] = (at, 0)
    for cue in _cues(text):
        space = _SPACE.search(text, cue.end())
        if space is None:
            continue
        words = _WORD.finditer(text, space.end())
        for distance in range(1, CUE_WORDS + 1):
            word = next(words, None)
            if word is None or word.start() - cue.end() > CUE_REACH:
                break
            before = found.get(word.start(), (0, 0))[1]
            found[word.start()] = (word.end(), min(before or distance, distance))
    return [(start, *found[start]) for start in sorted(found)]


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIMENSIONS


_frequent_slot = lru_cache(1 << 16)(_slot)


def _shape(token: str) -> str:
    if token.isalpha():
        if token.islower():
            return "a"
        if token.isupper():
            return "A"
    kinds = "".join(
        mark
        for mark, test in (("a", str.islower), ("A", str.isupper), ("0", str.isdigit))
        if any(test(c) for c in token)
    )
    return kinds or token


def _size(n: int) -> str:
    return str(n) if n < 4 else f"{min(n.bit_length(), 7)}b"


def _as_left(word: str) -> str:
    return word[-24:].lower()


def _as_right(word: str) -> str:
    return word[:24].lower()


FIRST, LAST = "<s>", "</s>"


def neighbours(words: list[str], at: int) -> tuple[str, str]:
    """The word before (to 24 characters) and after, in lower case."""
    before = words[at - 1] if at else FIRST
    after = words[at + 1] if at + 1 < len(words) else LAST
    return _as_left(before), _as_right(after)


def text_features(text: str, n_words: int) -> list[str]:
    return [
        f"doc.words={min(n_words, 5)}",
        f"doc.size={len(text).bit_length()}",
        f"doc.assigns={'=' in text}",
    ]


Form = tuple[str, int, int, bool, str, int, int]  # what most features of a token follow from


def _form(token: str, after: str, word_size: int) -> Form:
    """Shape, size (to 64, where all sizes are one), different characters, whether hexadecimal, what follows."""
    is_hex = not token.strip("0123456789abcdef")
    follows = after if len(after) < 3 else _shape(after)
    return _shape(token), min(len(token), 64), len(set(token)), is_hex, follows, min(len(after), 64), word_size


@lru_cache(1 << 15)
def _form_slots(form: Form, cue: int) -> tuple[int, ...]:
    shape, length, varied, is_hex, follows, after_size, word_size = form
    size = _size(length)
    return tuple(
        _slot(feature)
        for feature in (
            "bias",
            f"shape={shape}",
            f"size={size}",
            f"shape.size={shape}.{size}",
            f"shape.varied={shape}.{_size(varied)}",
            f"hex={is_hex}.{size}",
            f"after={follows}",
            f"after.size={_size(after_size)}.{shape}",
            f"word.size={_size(word_size)}.{shape}",
            f"cue={cue}.{shape}",
            f"cue.size={min(cue, 1)}.{shape}.{size}",
            f"cue.long={min(cue, 1)}.{shape}.{min(length // 4, 6)}",
        )
    )


def token_features(
    word: str, around: tuple[str, str] | None, whole: list[str], cue: int = 0
) -> tuple[list, list]:
    """Tokens of a word as (start, end), and the feature slots of each."""
    extents = [m.span() for m in _TOKEN.finditer(word)]
    tokens = [word[a:b] for a, b in extents]
    lowered = ["<w>", *(token.lower() for token in tokens), "</w>"]
    shared = [_frequent_slot(feature) for feature in whole]
    if around:
        shared += [_slot(f"left={around[0]}"), _slot(f"right={around[1]}")]
        left = _shape(around[0])
    slots = []
    for i, token in enumerate(tokens):
        form = _form(token, lowered[i + 2], min(len(word), 64))
        own = [*_form_slots(form, cue), _frequent_slot(f"head={token[:4]}"), _slot(f"before={lowered[i][-12:]}")]
        own += shared
        if around:
            own.append(_slot(f"left.shape={left}.{form[0]}"))
        slots.append(own)
    return extents, slots


@dataclass(frozen=True)
class Field:
    """Weights of the random field: per feature slot and tag, and between tags (B, I, O)."""

    emissions: np.ndarray
    moves: np.ndarray

    @cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon(self)

    def scores(self, slots: list[list[int]]) -> np.ndarray:
        return np.array([self.emissions[s].sum(axis=0) for s in slots])

    def tags(self, slots: list[list[int]]) -> np.ndarray:
        """Best tag sequence (Viterbi), starting from white space, which is outside."""
        scores = self.scores(slots)
        best = scores[0] + self.moves[2]
        back = []
        for row in scores[1:]:
            total = best[:, None] + self.moves
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + row
        tags = [int(best.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return np.array(tags[::-1])


class _Numbers(dict):
    """A number for each word, in the order of their first sight; ``added`` gets the new ones of a call together."""

    def __init__(self, added: Callable[[list[str], bool], None]):
        self.added, self.new, self.chars = added, [], 0

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of the words of texts, each between those of its ends."""
        if len(self) > HELD_WORDS or self.chars > HELD_CHARS:
            self.clear()
            self.chars = 0
        afresh, words = not self, []
        for own in texts:
            words.append(FIRST)
            words += own
            words.append(LAST)
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.chars += sum(map(len, self.new))
            self.added(self.new, afresh)
            self.new = []
        return numbers


def _crc_table() -> np.ndarray:
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = (rest >> 1) ^ (np.uint32(0xEDB88320) * (rest & 1))
    return rest


_CRC = _crc_table()


def _hashes(begun: str, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """As ``zlib.crc32``, of names that begin alike and go on with the bytes from ``first`` to ``last``."""
    order = np.argsort(first - last, kind="stable")
    first, sizes = first[order], (last - first)[order]
    rest = np.full(len(order), zlib.crc32(begun.encode()) ^ 0xFFFFFFFF, np.uint32)
    for place in range(int(sizes[0]) if len(sizes) else 0):
        n = np.searchsorted(-sizes, -place)  # longer than that
        own = rest[:n]
        rest[:n] = _CRC[(own ^ data[first[:n] + place]) & 0xFF] ^ (own >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = rest ^ np.uint32(0xFFFFFFFF)
    return out


def _slots_of(begun: str, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return _hashes(begun, data, first, last) % DIMENSIONS


def _lines(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words, where each begins, and where it ends."""
    data = np.frombuffer(("\n".join(words) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    last = np.flatnonzero(data == 10)
    return data, np.append(0, last[:-1] + 1), last


_LOWER, _UPPER, _DIGIT, _ALNUM, _NOT_HEX = 1, 2, 4, 8, 16
_MIXES = ["".join(m for m, bit in zip("aA0", (_LOWER, _UPPER, _DIGIT)) if mix & bit) for mix in range(8)]
_MIX = _LOWER | _UPPER | _DIGIT
_UNKNOWN = 255
_BIT_OF = np.zeros(128, np.uint64)  # of the 62 letters and digits of ASCII
_BIT_OF[[ord(c) for c in string.ascii_letters + string.digits]] = np.arange(62)


def _character(code: int) -> int:
    c = chr(code)
    alnum = c.isascii() and c.isalnum()
    return (
        _LOWER * c.islower() | _UPPER * c.isupper() | _DIGIT * c.isdigit() | _ALNUM * alnum
        | _NOT_HEX * (c not in "0123456789abcdef")
    )


def _shape_name(shape: int) -> str:
    return _MIXES[shape] if shape < 8 else chr(shape - 8)


class Lexicon:
    """What B and I can gain over O in ordinary words: by a word's own tokens (the most of them), by the words
    beside it, and by the shapes of the word before and of its tokens.

    The features are those of ``token_features``, for many words at a time. A shape is a number here: below 8 a
    mix of small and capital letters and digits, else 8 more than the code of the character that it is."""

    def __init__(self, field: Field):
        self.gain = field.emissions[:, :2] - field.emissions[:, 2:]
        into = field.moves[:, :2].max(axis=0) - field.moves[2, 2]
        self.moved = into + np.maximum(0, field.moves[:2, 2] - field.moves[2, 2])
        self.numbers = _Numbers(self._add)
        self.characters = np.full(0x110000, _UNKNOWN, np.uint8)
        self.forms = {}
        self._forget()

    def _forget(self) -> None:
        self.scores = np.zeros((0, 6))  # own, as the word before, as the word after
        self.kinds = np.zeros((0, 2), np.int64)  # shape as the word before, shapes of the tokens
        self.shapes, self.groups, self.pairs = {mix: at for at, mix in enumerate(_MIXES)}, {}, {}
        if len(self.forms) > HELD_WORDS:
            self.forms.clear()

    def _add(self, words: list[str], afresh: bool) -> None:
        if afresh:
            self._forget()
        first, held = 0, 0
        for at, word in enumerate(words):
            held += len(word)
            if held > PART_CHARS or at + 1 == len(words):
                self._add_part(words[first : at + 1])
                first, held = at + 1, 0

    def _add_part(self, words: list[str]) -> None:
        own, groups = self._own(words)
        shapes, beside = self._beside(words)
        self.scores = np.concatenate([self.scores, np.concatenate([own, beside], axis=1)])
        self.kinds = np.concatenate([self.kinds, np.stack([shapes, groups], axis=1)])

    def _marks(self, codes: np.ndarray) -> np.ndarray:
        marks = self.characters[codes]
        if (marks == _UNKNOWN).any():
            for code in np.unique(codes[marks == _UNKNOWN]).tolist():
                self.characters[code] = _character(code)
            marks = self.characters[codes]
        return marks

    def _beside(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shapes of the words as the ones before, and what they gain as the ones before and after."""
        lowered = [_as_left(word) for word in words]
        codes = _codes("\n".join(lowered) + "\n")
        ends = np.flatnonzero(codes == 10)
        mixes = np.bitwise_or.reduceat(self._marks(codes), np.append(0, ends[:-1] + 1)) & _MIX
        shapes = mixes.astype(np.int64)
        for at in np.flatnonzero(mixes == 0).tolist():
            shapes[at] = self.shapes.setdefault(lowered[at], len(self.shapes))
        left, right = (_slots_of(name, *_lines(lowered)) for name in ("left=", "right="))
        for at in np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) > 24).tolist():
            right[at] = _slot(f"right={_as_right(words[at])}")
        return shapes, np.concatenate([self.gain[left], self.gain[right]], axis=1)

    def _own(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The most that a token of each word gains by its own features, and the shapes of the tokens."""
        codes = _codes("\n".join(words) + "\n")
        marks = self._marks(codes)
        alnum, is_end = (marks & _ALNUM) > 0, codes == 10
        begins = ~alnum
        begins[1:] |= ~alnum[:-1]
        begins[0] = True
        bounds = np.flatnonzero(begins)  # of tokens and ends of words
        is_token = ~is_end[bounds]
        start, stop = bounds[is_token], np.append(bounds[1:], len(codes))[is_token]
        of_word = np.cumsum(is_end)[start]
        first = np.append(True, of_word[1:] != of_word[:-1])
        last = np.append(first[1:], True)

        mixed = np.bitwise_or.reduceat(marks, bounds)[is_token]
        is_run, mix = alnum[start], (mixed & _MIX).astype(np.int64)
        shape = np.where(mix > 0, mix, codes[start] + 8)
        size = np.minimum(stop - start, 64)
        bits = np.where(alnum, np.uint64(1) << _BIT_OF[np.minimum(codes, 127)], np.uint64(0))
        varied = np.bitwise_count(np.bitwise_or.reduceat(bits, bounds)[is_token]).astype(np.int64)
        varied = np.where(is_run, varied, 1)
        own = ((shape << 7 | size) << 7 | varied) << 1 | ((mixed & _NOT_HEX) == 0)

        # a token of 3 characters or more follows as its shape in small letters, a shorter one as it is
        second = np.where(size == 2, codes[np.minimum(start + 1, len(codes) - 1)], 0)
        small = np.where(mix & (_LOWER | _UPPER), _LOWER, 0) | (mix & _DIGIT)
        follower = np.where(size > 2, 1 << 42 | small << 7 | size, second << 21 | codes[start])
        after = np.append(follower[1:], 0)
        after[last] = 1 << 42 | _LOWER << 7 | 4  # </w>
        word_size = np.bincount(of_word, stop - start, len(words)).astype(np.int64)
        gained = self._form_gains(own, after, np.minimum(word_size, 64)[of_word])

        data = codes.astype(np.uint8)
        for_head, for_before = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        for_head[is_run] = _slots_of("head=", data, start[is_run], np.minimum(start + 4, stop)[is_run])
        data = np.where(marks & _UPPER, data | 32, data)
        for_before[is_run] = _slots_of("before=", data, np.maximum(start, stop - 12)[is_run], stop[is_run])
        single, place = np.unique(codes[start[~is_run]], return_inverse=True)
        single = [chr(code) for code in single.tolist()]
        for_head[~is_run] = np.array([_slot(f"head={c}") for c in single], np.int64)[place]
        for_before[~is_run] = np.array([_slot(f"before={c.lower()}") for c in single], np.int64)[place]
        before = np.append(0, for_before[:-1])
        before[first] = _slot("before=<w>")
        gained += self.gain[for_head] + self.gain[before]
        most = np.maximum.reduceat(gained, np.flatnonzero(first))

        shape_bits = 22
        sets = np.unique(of_word << shape_bits | shape)
        cuts = [*np.flatnonzero(np.diff(sets >> shape_bits, prepend=-1)).tolist(), len(sets)]
        shapes = (sets & ((1 << shape_bits) - 1)).tolist()
        known = self.groups
        groups = [known.setdefault(tuple(shapes[a:b]), len(known)) for a, b in zip(cuts, cuts[1:])]
        return most, np.array(groups, np.int64)

    def _form_gains(self, own: np.ndarray, after: np.ndarray, word_size: np.ndarray) -> np.ndarray:
        owns, own = np.unique(own, return_inverse=True)
        afters, after = np.unique(after, return_inverse=True)
        codes, place = np.unique((own * len(afters) + after) * 65 + word_size, return_inverse=True)
        pairs, sizes = np.divmod(codes, 65)
        owns, afters = owns[pairs // len(afters)], afters[pairs % len(afters)]
        known, keys = self.forms, list(zip(owns.tolist(), afters.tolist(), sizes.tolist()))
        for key in keys:
            if key not in known:
                known[key] = self.gain[list(_form_slots(self._form(*key), 0))].sum(axis=0)
        return np.array([known[key] for key in keys])[place]

    @staticmethod
    def _form(own: int, after: int, word_size: int) -> Form:
        shape, size, varied = own >> 15, own >> 8 & 127, own >> 1 & 127
        if after >> 42:
            follows, after_size = _MIXES[after >> 7 & 7], after & 127
        else:
            follows = "".join(chr(c) for c in (after & 0x1FFFFF, after >> 21) if c).lower()
            after_size = len(follows)
        return _shape_name(shape), size, varied, bool(own & 1), follows, after_size, word_size

    def _pair(self, code: int) -> np.ndarray:
        if code not in self.pairs:
            if len(self.pairs) > HELD_WORDS:
                self.pairs.clear()
            shape, tokens = self._names[0][code >> 32], self._names[1][code & 0xFFFFFFFF]
            gains = [self.gain[_slot(f"left.shape={shape}.{_shape_name(token)}")] for token in tokens]
            self.pairs[code] = np.max(gains, axis=0) if gains else np.zeros(2)
        return self.pairs[code]

    def doubtful(self, texts: list[list[str]], wholes: list[list[str]]) -> list[np.ndarray]:
        """For each text, given as its words, the places of those not certain to be outside, if they are near no cue.

        Any other tags differ from all outside by what their tokens gain and by their moves; each token's moves are
        at most ``moved``, so where no token and tag gains more than that costs, none of them is better."""
        number = self.numbers.of(texts)
        word, before, after = number[1:-1], number[:-2], number[2:]
        codes, place = np.unique((self.kinds[before, 0] << 32) | self.kinds[word, 1], return_inverse=True)
        codes = codes.tolist()
        if any(code not in self.pairs for code in codes):
            self._names = list(self.shapes), list(self.groups)
        pairs = np.array([self._pair(code) for code in codes]).reshape(-1, 2)
        most = self.scores[word, :2] + self.scores[before, 2:4] + self.scores[after, 4:] + pairs[place]
        most += self.moved
        out, at = [], 0
        for words, whole in zip(texts, wholes):
            own = most[at : at + len(words)] + self.gain[[_slot(f) for f in whole]].sum(axis=0)
            out.append(np.flatnonzero(own.max(axis=1) >= SURE))
            at += len(words) + 2
        return out


_FORBIDDEN = np.array([[0, 0, 0], [0, 0, 0], [0, -1e4, 0]], dtype=float)  # never I after O


def _gradient(field: Field, slots: np.ndarray, gold: np.ndarray):
    """Of the log-likelihood, over chains of one length. slots: n x length x features."""
    n, length, _ = slots.shape
    scores = field.emissions[slots].sum(axis=2)
    ahead = np.empty((n, length, 3))
    behind = np.zeros((n, length, 3))
    ahead[:, 0] = scores[:, 0] + field.moves[2]
    for i in range(1, length):
        ahead[:, i] = np.logaddexp.reduce(ahead[:, i - 1, :, None] + field.moves, axis=1) + scores[:, i]
    for i in range(length - 2, -1, -1):
        behind[:, i] = np.logaddexp.reduce(
            field.moves + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2
        )
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    chance = np.exp(ahead + behind - total[:, None, None])
    hot = np.eye(3)[gold]
    rest = hot - chance
    emissions = np.stack(
        [
            np.bincount(slots.ravel(), np.repeat(rest[:, :, t].ravel(), slots.shape[2]), DIMENSIONS + 1)
            for t in range(3)
        ],
        axis=1,
    )
    moves = np.zeros((3, 3))
    moves[2] += rest[:, 0].sum(axis=0)
    for i in range(1, length):
        pair = ahead[:, i - 1, :, None] + field.moves + (scores[:, i] + behind[:, i])[:, None, :]
        moves += np.einsum("na,nb->ab", hot[:, i - 1], hot[:, i])
        moves -= np.exp(pair - total[:, None, None]).sum(axis=0)
    value = (scores * hot).sum() + field.moves[2][gold[:, 0]].sum() - total.sum()
    if length > 1:
        value += field.moves[gold[:, :-1], gold[:, 1:]].sum()
    return emissions, moves, value


def fit_field(words: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a small ridge penalty, by gradient steps of adaptive size."""
    groups: dict[int, list] = {}
    for slots, gold in words:
        groups.setdefault(len(gold), []).append((slots, gold))
    batches = []
    for length in sorted(groups):
        width = max(len(s) for slots, _ in groups[length] for s in slots)
        grid = np.full((len(groups[length]), length, width), DIMENSIONS)  # the last slot is padding
        for i, (slots, _) in enumerate(groups[length]):
            for j, own in enumerate(slots):
                grid[i, j, : len(own)] = own
        batches.append((grid, np.array([gold for _, gold in groups[length]])))
    field = Field(np.zeros((DIMENSIONS + 1, 3)), _FORBIDDEN.copy())
    field.emissions[_slot("bias"), 2] = 1.0  # outside, before anything is known
    state = [np.zeros_like(field.emissions), np.zeros_like(field.moves)]
    for _ in range(rounds if words else 0):
        grown = [np.zeros_like(x) for x in state]
        for slots, gold in batches:
            emissions, moves, _ = _gradient(field, slots, gold)
            grown[0] += emissions
            grown[1] += moves
        weights = [field.emissions, field.moves - _FORBIDDEN]
        for i, gradient in enumerate(grown):
            gradient -= 0.1 * weights[i]
            state[i] += gradient**2
            weights[i] = weights[i] + 0.5 * gradient / np.sqrt(state[i] + 1e-8)
        weights[0][DIMENSIONS] = 0.0
        field = Field(weights[0], weights[1] + _FORBIDDEN)
    return field


def _gold(start: int, extents: list[tuple[int, int]], inner: list[tuple[int, int]]) -> list[int]:
    tags, held = [], None
    for a, b in extents:
        at = next((s for s in inner if s[0] <= start + a and start + b <= s[1]), None)
        tags.append(2 if at is None else 1 if at == held else 0)
        held = at
    return tags


def _redrawn(word: str, gold: list[int]) -> str:
    """The word with each secret token of 6+ characters drawn anew, in the same places."""
    draw = random.Random(word)
    letters = list(word)
    for (a, b), tag in zip([m.span() for m in _TOKEN.finditer(word)], gold):
        if tag != 2 and b - a >= 6:
            letters[a:b] = draw.choices(string.ascii_letters + string.digits, k=b - a)
    return "".join(letters)


def _alone(length: int, seed: str) -> list[tuple[str, int]]:
    """Secrets to be seen alone behind a cue, and how far behind."""
    draw = random.Random(seed)
    letters = "".join(draw.choices(string.ascii_lowercase, k=max(16, length)))
    mixed = "".join(draw.choices(string.ascii_lowercase + string.digits, k=max(8, min(length, 24))))
    short = "".join(draw.choices(string.ascii_lowercase, k=5)) + "".join(draw.choices(string.digits, k=2))
    short += draw.choice(string.ascii_lowercase)
    middle = "".join(draw.choices(string.ascii_lowercase[:13], k=draw.randrange(16, 32)))  # few different letters
    return [(word, 1 + i % 2) for i, word in enumerate((letters, mixed, short, middle))]


Chain = tuple[list[list[int]], list[int]]  # feature slots and tags of its tokens


def _any(place: int, kind: str) -> bool:
    return True


def chains(
    text: str, wanted: Callable[[int, str], bool] = _any, found: list | None = None
) -> Iterator[tuple[int, bool, list[Chain]]]:
    """Hash, whether a secret is in it, and the forms to be learnt, of each wanted chain of the suspect words of a
    whole text."""
    found = candidate_words(text) if found is None else found
    if not found:
        return
    about = text_features(text, len(found))
    inner = pattern_spans(text)[1]
    words, starts = text.split(), word_starts(text)
    for start, end, cue in found:
        word, around = text[start:end], neighbours(words, int(np.searchsorted(starts, start)))
        extents = [m.span() for m in _TOKEN.finditer(word)]
        gold = _gold(start, extents, inner)
        slots = bare = None
        for first in range(0, len(extents), CHAIN):
            last = min(first + CHAIN, len(extents))
            own = gold[first:last]
            if own and own[0] == 1:
                own = [0, *own[1:]]
            piece = word[extents[first][0] : extents[last - 1][1]]
            place = zlib.crc32(f"{around[0]} {piece} {around[1]}".encode())
            if not wanted(place, "secret" if 0 in own else "plain"):
                continue
            if slots is None:
                slots = token_features(word, around, about, cue)[1]
                bare = token_features(word, None, about)[1]
            forms = [(slots[first:last], own), (bare[first:last], own)]
            if 0 in own:
                forms.append((token_features(_redrawn(piece, own), None, about)[1], own))
                length = max(b - a for (a, b), tag in zip(extents[first:last], own) if tag != 2)
                for secret, distance in _alone(length, piece):
                    for left in ("is", around[0]):
                        forms.append((token_features(secret, (left, around[1]), about, distance)[1], [0]))
            else:
                for ordinary in around:
                    if _WORD.fullmatch(ordinary) and not _UNUSUAL.search(ordinary) and ordinary.isalpha():
                        behind = token_features(ordinary, ("is", around[1]), about, 1 + place % 2)[1]
                        forms.append((behind, [2] * len(behind)))
            yield place, 0 in own, forms


class _Contexts:
    """A hash for each word of texts with its neighbours and the features of the whole text."""

    def places(self, texts: list[list[str]], wholes: list[list[str]]) -> list[np.ndarray]:
        words = []
        for own in texts:
            words.append(FIRST)
            words += own
            words.append(LAST)
        if not words:
            return []
        own = _hashes("", *_lines(words)).astype(np.uint64) + np.uint64(1)
        mixed = own[1:-1] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= own[:-2] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= own[2:] * np.uint64(0x165667B19E3779F9)
        out, at = [], 0
        for own, whole in zip(texts, wholes):
            places = mixed[at : at + len(own)] ^ np.uint64(zlib.crc32(" ".join(whole).encode()))
            places *= np.uint64(0xD6E8FEB86659FD93)
            out.append((places >> np.uint64(32)).astype(np.int64))
            at += len(own) + 2
        return out


Ordinary = tuple[str, tuple[str, str], list[str], list[int]]  # a word, its neighbours, the text's features, its tags


def ordinary_words(
    text: str, contexts: _Contexts, bound: int = 1 << 32, found: list | None = None, places: np.ndarray | None = None
) -> Iterator[tuple[int, Ordinary]]:
    """All words of a whole text that are not suspect and whose hash is below a bound."""
    words = text.split() if places is None or (places < bound).any() else []
    if not words:
        return
    found = candidate_words(text) if found is None else found
    about = text_features(text, len(found))
    if places is None:
        places = contexts.places([words], [about])[0]
    taken = np.flatnonzero(places < bound).tolist()
    if not taken:
        return
    suspect = {word[0] for word in found}
    inner = pattern_spans(text)[1]
    starts = word_starts(text).tolist()
    for at in taken:
        if starts[at] not in suspect:
            gold = _gold(starts[at], [m.span() for m in _TOKEN.finditer(words[at])], inner)
            yield int(places[at]), (words[at], neighbours(words, at), about, gold)


def ordinary_chains(one: Ordinary) -> list[Chain]:
    word, around, about, gold = one
    slots, out = token_features(word, around, about)[1], []
    for first in range(0, len(gold), CHAIN):
        own = gold[first : first + CHAIN]
        out.append((slots[first : first + CHAIN], [0, *own[1:]] if own[0] == 1 else own))
    return out


class _Least:
    """The rows of the smallest hashes, one per hash, at most ``limit``."""

    def __init__(self, limit: int):
        self.limit, self.rows, self.bound = limit, {}, 1 << 32

    def takes(self, place: int) -> bool:
        return place < self.bound and place not in self.rows

    def least_bound(self) -> int:
        """No hash from here on is among the least of all rows, of which these are some."""
        return sorted(self.rows)[self.limit - 1] + 1 if len(self.rows) >= self.limit else 1 << 32

    def offer(self, place: int, forms: list[Chain] | Ordinary) -> None:
        if not self.takes(place):
            return
        self.rows[place] = forms
        if len(self.rows) >= 2 * self.limit:
            kept = sorted(self.rows)[: self.limit]
            self.rows = {p: self.rows[p] for p in kept}
            self.bound = kept[-1] + 1


def training_chains(
    docs: DataFrame, text: str, secrets: int, plain: int, ordinary: int = FIT_ORDINARY
) -> list[Chain]:
    """Forms of at most so many different chains with and without a secret, and of ordinary words, those of the
    smallest hash.

    A task keeps no more than that itself; it also says how many chains it has seen, from which follows a bound on
    the hash that leaves several times as many over all tasks as are taken, so each sends few. Of the many ordinary
    words none is needed beyond the least bound of a task that has its number."""
    limits = {"secret": secrets, "plain": plain, "ordinary": ordinary}

    def run(batches):
        held, seen = {kind: _Least(limit) for kind, limit in limits.items()}, dict.fromkeys(limits, 0)
        contexts = _Contexts()

        def wanted(place, kind):
            seen[kind] += 1
            return held[kind].takes(place)

        for batch in batches:
            for _, texts in text_slices(batch, text):
                words = [whole.split() for whole in texts]
                suspects = [candidate_words(whole, own) for whole, own in zip(texts, words)]
                about = [text_features(whole, len(found)) for whole, found in zip(texts, suspects)]
                for whole, found, places in zip(texts, suspects, contexts.places(words, about)):
                    for place, secret, forms in chains(whole, wanted, found):
                        held["secret" if secret else "plain"].offer(place, forms)
                    others = held["ordinary"]
                    for place, one in ordinary_words(whole, contexts, others.bound, found, places):
                        others.offer(place, one)
        bounds = {kind: least.least_bound() for kind, least in held.items()}
        rows = [(kind, -1, seen[kind], bounds[kind], [], []) for kind in limits]
        for kind, least in held.items():
            for place in sorted(least.rows)[: least.limit]:
                forms = least.rows[place] if kind != "ordinary" else ordinary_chains(least.rows[place])
                rows.append((kind, place, 0, bounds[kind], [f[0] for f in forms], [f[1] for f in forms]))
        lists = pa.list_(pa.list_(pa.int32()))
        for first in range(0, len(rows), 256):
            part = rows[first : first + 256]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part], pa.string()),
                    pa.array([r[1] for r in part], pa.int64()),
                    pa.array([r[2] for r in part], pa.int64()),
                    pa.array([r[3] for r in part], pa.int64()),
                    pa.array([r[4] for r in part], pa.list_(lists)),
                    pa.array([r[5] for r in part], lists),
                ],
                names=["kind", "place", "seen", "bound", "slots", "gold"],
            )

    schema = "kind string, place long, seen long, bound long, slots array<array<array<int>>>, gold array<array<int>>"
    steps = Steps(docs.sparkSession)
    rows = steps.keep(docs.select(text).mapInArrow(run, schema), "secret_chains")
    told = rows.groupBy("kind").agg(F.sum("seen").alias("seen"), F.min("bound").alias("bound")).collect()
    told = {r["kind"]: r for r in told}
    out = []
    for kind, limit in limits.items():
        if kind not in told:
            continue
        bound = told[kind]["bound"]
        if kind != "ordinary":
            bound = min(1 << 32, (SPARE * limit << 32) // max(told[kind]["seen"], 1))
        some = rows.filter((F.col("kind") == kind) & (F.col("place") >= 0) & (F.col("place") < bound))
        # equal hashes are mostly equal chains of several tasks
        taken = (
            some.groupBy("place").agg(F.min(F.struct("gold", "slots")).alias("one"))
            .orderBy("place").limit(limit).select("one.gold", "one.slots").toArrow()
        )
        for gold, slots in zip(taken.column("gold"), taken.column("slots")):
            for tags, own in zip(gold.values, slots.values):
                if len(tags):
                    out.append(([token.values.to_numpy() for token in own.values], tags.values.to_pylist()))
    return out


def tagged_spans(text: str, field: Field, known: list[Span]) -> list[Span]:
    """Spans the field adds: none overlaps a known span."""
    return tagged_spans_of([text], field, [known])[0]


def tagged_spans_of(texts: list[str], field: Field, known: list[list[Span]]) -> list[list[Span]]:
    """The same of many texts, whose words meet the lexicon together."""
    split = [text.split() for text in texts]
    found = [candidate_words(text, words) for text, words in zip(texts, split)]
    about = [text_features(text, len(own)) for text, own in zip(texts, found)]
    doubtful = field.lexicon.doubtful(split, about)
    return [_decoded(field, *one) for one in zip(texts, split, found, about, doubtful, known)]


def _decoded(
    field: Field, text: str, words: list[str], found: list, about: list[str], doubtful: np.ndarray, known: list[Span]
) -> list[Span]:
    """Spans of the suspect and the doubtful words."""
    doubtful = doubtful.tolist()
    if not found and not doubtful:
        return []
    starts = word_starts(text)
    cues = dict.fromkeys(doubtful, 0)
    cues |= {int(np.searchsorted(starts, start)): cue for start, _, cue in found}
    added = []
    for at in sorted(cues):
        start = int(starts[at])
        end = start + len(words[at])
        if any(a <= start and end <= b for _, a, b in known):
            continue
        extents, slots = token_features(words[at], neighbours(words, at), about, cues[at])
        open_at = None
        for (a, b), tag in zip(extents, field.tags(slots)):
            if tag != 1 and open_at is not None:
                added.append((3, open_at, stop))
                open_at = None
            if tag == 0:
                open_at = start + a
            stop = start + b
        if open_at is not None:
            added.append((3, open_at, stop))
    return [s for s in added if not any(a < s[2] and s[1] < b for _, a, b in known)]


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans, and all spans, each by start and kind, of each text."""
    base = [pattern_spans(text)[0] for text in texts]
    tagged = tagged_spans_of(texts, field, base)
    return [(own, sorted(own + more, key=lambda s: (s[1], s[0]))) for own, more in zip(base, tagged)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame, text: str = "text", secrets: int = FIT_SECRETS, plain: int = FIT_PLAIN) -> Field:
    return fit_field(training_chains(docs, text, secrets, plain))


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


def find_secrets(
    docs: DataFrame, field: Field, text: str = "text", spans: str = "secret_spans"
) -> DataFrame:
    """Append all spans of each text as an array of (kind, start, end)."""
    rest = [name for name in docs.columns if name != spans]
    schema = T.StructType([*(docs.schema[n] for n in rest), T.StructField(spans, SPANS)])
    weights = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    )

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, text):
                found = [
                    [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
                    for _, spans in all_spans(texts, weights.value)
                ]
                part = batch.slice(first, len(texts)).select(rest)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*rest, spans])

    return docs.mapInArrow(run, schema)


def mask(
    docs: DataFrame, field: Field, text: str = "text", mark: str = "[SECRET]"
) -> DataFrame:
    """Replace every span by a mark; overlapping spans become one. All columns stay."""
    columns = docs.columns
    weights = docs.sparkSession.sparkContext.broadcast(field)

    def cleaned(whole: str, spans: list[Span]) -> str:
        parts, at = [], 0
        for _, start, end in spans:
            if start >= at:
                parts += [whole[at:start], mark]
            at = max(at, end)
        return "".join([*parts, whole[at:]])

    def run(batches):
        place = columns.index(text)
        for batch in batches:
            for first, texts in text_slices(batch, text):
                part = batch.slice(first, len(texts))
                present = part.column(place).is_valid().to_pylist()
                found = all_spans(texts, weights.value)
                new = [cleaned(t, s) if there else None for t, there, (_, s) in zip(texts, present, found)]
                arrays = list(part.columns)
                arrays[place] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(run, docs.schema)


def secret_digests(
    docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: spans by kind, digest of the pattern spans, and all spans as text."""
    weights = docs.sparkSession.sparkContext.broadcast(field)
    counted = ["n_assign", "n_access", "n_hex", "n_crf"]
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            *(T.StructField(name, T.LongType()) for name in counted[:3]),
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
            T.StructField("n_crf", T.LongType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, text):
                counts = [[] for _ in counted]
                digests, spans = [], []
                for base, found in all_spans(texts, weights.value):
                    for kind, held in enumerate(counts):
                        held.append(sum(s[0] == kind for s in found))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(found))
                longs = [pa.array(c, pa.int64()) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(doc_id).slice(first, len(texts)),
                        *longs[:3],
                        pa.array(digests, pa.string()),
                        pa.array(spans, pa.string()),
                        longs[3],
                    ],
                    names=schema.names,
                )

    return docs.select(doc_id, text).mapInArrow(run, schema)

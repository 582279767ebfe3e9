"""Words and word shingles of many texts at once, as 64-bit hashes (NumPy over UTF-8 bytes).

The hash of a byte string is a polynomial over mixed byte values modulo 2**64, read off prefix
sums, so all words of a batch are hashed by a few array operations. The five ASCII white space
characters 09 to 0D and the space separate words; only A-Z are lowered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (shift and multiply rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _repeated(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, BLOCK + 1)
        _POWERS = _repeated(_BASE, size)
        _INVERSE = _repeated(pow(_BASE, -1, 1 << 64), size)
    return _POWERS, _INVERSE


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """p with p[i] = sum of value[j] * base**j for j < i; see ``piece_hashes``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def piece_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the pieces [start, end): equal pieces have equal hashes wherever they lie."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * down[start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column without nulls, and the offset of each text."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Rows in runs of at most ``limit`` bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts cut at white space; a word longer than a part is not cut."""
    first = 0
    while len(data) - first > BLOCK:
        at = first + BLOCK
        cut = None
        while at < len(data) and cut is None:
            found = np.flatnonzero(_SPACE[data[at : at + BLOCK]])
            cut = at + int(found[0]) if len(found) else None
            at += BLOCK
        if cut is None:
            break
        yield data[first:cut]
        first = cut
    yield data[first:]


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of all words of these rows, offsets of each row's words)."""
    data, offsets = text_bytes(column)
    for first, last in runs(offsets):
        begin, end = offsets[first], offsets[last]
        own = _LOWER[data[begin:end]]
        if last - first == 1 and end - begin > BLOCK:
            parts = []
            for piece in _pieces(own):
                starts, ends = _word_bounds(piece, np.array([0, len(piece)]))
                parts.append(mixed(piece_hashes(prefix_hashes(piece), starts, ends)))
            hashes = np.concatenate(parts)
            yield first, last, hashes, np.array([0, len(hashes)])
            continue
        starts, ends = _word_bounds(own, offsets[first : last + 1] - begin)
        hashes = mixed(piece_hashes(prefix_hashes(own), starts, ends))
        yield first, last, hashes, np.searchsorted(starts, offsets[first : last + 1] - begin)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for place in range(width):
            out = out * _U(0x9E3779B97F4A7C15) + words[place : place + len(out)]
            out ^= out >> _U(29)
        return mixed(out + _U(width))

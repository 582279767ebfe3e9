"""Codes of interleaved bits (Z-order), and the next one inside a box."""

from __future__ import annotations

import numpy as np

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def interleaved(column: int, row: int, bits: int) -> int:
    """Bit i of the column becomes bit 2i, bit i of the row bit 2i + 1."""
    code = 0
    for i in range(bits):
        code |= ((column >> i) & 1) << (2 * i) | ((row >> i) & 1) << (2 * i + 1)
    return code


def next_in_box(codes: np.ndarray, low: int, high: int, bits: int) -> np.ndarray:
    """For each code the smallest one not below it whose column and row lie between those of ``low`` and
    ``high``; all ones where there is none.

    The bits are read from the top. Where the box spans both halves of a bit and the code lies in the
    lower one, the first code of the upper half is kept as an answer for the case that the lower half
    turns out to have none.
    """
    codes = codes.astype(np.uint64)
    low_now, high_now = np.full(len(codes), low, np.uint64), np.full(len(codes), high, np.uint64)
    best = np.full(len(codes), _NONE)
    open_ = np.ones(len(codes), bool)
    for place in range(2 * bits - 1, -1, -1):
        bit = np.uint64(1 << place)
        # lower bits of the same axis
        below = np.uint64(sum(1 << p for p in range(place - 2, -1, -2)))
        code, first, last = ((v & bit) > 0 for v in (codes, low_now, high_now))
        split = open_ & ~first & last
        upper_start = (low_now | bit) & ~below
        lower_end = (high_now & ~bit) | below
        best = np.where(split & ~code, upper_start, best)
        high_now = np.where(split & ~code, lower_end, high_now)
        low_now = np.where(split & code, upper_start, low_now)
        # the whole box lies above the code, or below it
        ahead, passed = open_ & ~code & first, open_ & code & ~last
        best = np.where(ahead, low_now, best)
        open_ &= ~(ahead | passed)
    return np.where(open_, codes, best)

"""Recurring ranges on wrapping axes (24 hours, 7 days, 12 months) and their predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS, DAYS, MONTHS = 24.0, 7.0, 12.0


def within(
    q_start: Column,
    q_end: Column,
    p_start: Column,
    p_end: Column,
    base: float,
    strict: bool = False,
) -> Column:
    """Whether the query range lies inside the parent range; both ends are closed.

    An end below its start means the range wraps. Under a wrapping parent, a query that
    does not wrap has each end moved up by ``base`` on its own when it lies below the
    parent's start, so 5-23 counts as inside 22-7. ``strict`` moves both ends together.
    """
    turn = F.lit(float(base))
    q_wraps, p_wraps = q_end < q_start, p_end < p_start

    straight_parent = (q_start >= p_start) & (
        F.when(q_wraps, q_end + turn).otherwise(q_end) <= p_end
    )
    both_wrap = (q_start >= p_start) & (q_end + turn <= p_end + turn)
    if strict:
        early = q_start < p_start
        straight_query = F.when(early, q_end + turn <= p_end + turn).otherwise(
            q_end <= p_end + turn
        )
        straight_query = straight_query & (
            F.when(early, q_start + turn).otherwise(q_start) >= p_start
        )
    else:
        def lift(bound: Column) -> Column:
            return F.when(bound < p_start, bound + turn).otherwise(bound)

        straight_query = (lift(q_start) >= p_start) & (lift(q_end) <= p_end + turn)

    return (
        F.when(~p_wraps, straight_parent).when(q_wraps, both_wrap).otherwise(straight_query)
    )


def any_within(
    q_start: Column, q_end: Column, ranges: Column, base: float, strict: bool = False
) -> Column:
    """Whether some range of the array contains the query; an empty array contains none."""
    hit = F.exists(ranges, lambda r: within(q_start, q_end, r["start"], r["end"], base, strict))
    return F.coalesce(hit, F.lit(False))


def all_within(
    q_start: Column, q_end: Column, ranges: Column, base: float, negate: Column,
    strict: bool = False,
) -> Column:
    """Whether every range passes, each containment test being negated on its own."""
    hit = F.forall(
        ranges, lambda r: within(q_start, q_end, r["start"], r["end"], base, strict) != negate
    )
    return F.coalesce(hit, F.lit(False))


def is_empty(ranges: Column) -> Column:
    return F.coalesce(F.size(ranges), F.lit(0)) <= 0


# Truth bitmaps. On an axis of whole numbers 1 to ``size`` there are size * size query ranges. One bit for each
# says whether a list of ranges contains it, and the test is a shift. A word holds so many bits:
_WORD_BITS = {7: 49, 12: 48}
_KINDS = [(kind, strict) for kind in ("any", "all") for strict in (False, True)]


def contains(q: tuple[int, int], p: tuple[int, int], base: int, strict: bool = False) -> bool:
    """``within`` for two pairs of plain numbers."""
    (q_start, q_end), (p_start, p_end) = q, p
    q_wraps = q_end < q_start
    if p_start <= p_end:
        return q_start >= p_start and q_end + (base if q_wraps else 0) <= p_end
    if q_wraps:
        return q_start >= p_start and q_end <= p_end
    if strict:
        turn = base if q_start < p_start else 0
        return q_start + turn >= p_start and q_end + turn <= p_end + base
    lifted = [v + base if v < p_start else v for v in q]
    return lifted[0] >= p_start and lifted[1] <= p_end + base


def _words(size: int) -> int:
    return -(-size * size // _WORD_BITS[size])


def _truth_of(parent: tuple[int, int], size: int, strict: bool) -> list[int]:
    """Words of bits: bit (q_start - 1) * size + q_end - 1 tells whether the parent contains the query."""
    per_word, words = _WORD_BITS[size], [0] * _words(size)
    for place in range(size * size):
        query = (place // size + 1, place % size + 1)
        if contains(query, parent, size, strict):
            words[place // per_word] |= 1 << place % per_word
    return words


def truth_bitmaps(ranges: Column, size: int) -> Column:
    """All words of a list of ranges with ends 1 to ``size``, by kind: some range contains the query, strictly
    so, every range does, strictly so. Made once per list; null for a null list."""
    parents = [(s, e) for s in range(1, size + 1) for e in range(1, size + 1)]
    full = (1 << _WORD_BITS[size]) - 1
    words = []
    for kind, strict in _KINDS:
        table = [_truth_of(parent, size, strict) for parent in parents]
        for word in range(_words(size)):
            of_parent = F.array(*[F.lit(row[word]).cast("bigint") for row in table])

            def own(r: Column, of_parent=of_parent) -> Column:
                return F.get(of_parent, ((r["start"] - 1) * size + r["end"] - 1).cast("int"))

            if kind == "any":
                none = F.lit(0).cast("bigint")
                words.append(F.aggregate(ranges, none, lambda acc, r: acc.bitwiseOR(own(r))))
            else:
                every = F.lit(full).cast("bigint")
                words.append(F.aggregate(ranges, every, lambda acc, r: acc.bitwiseAND(own(r))))
    return F.when(ranges.isNotNull(), F.array(*words))


def truth_bit(bitmaps: Column, ends: tuple[Column, Column], size: int, kind: str, strict: bool) -> Column:
    """Whether some or every range of a list contains the query, whose ends are whole numbers 1 to ``size``."""
    place = ((ends[0] - 1) * size + ends[1] - 1).cast("int")
    first = _KINDS.index((kind, strict)) * _words(size)
    per_word = F.lit(_WORD_BITS[size])
    word = F.get(bitmaps, F.lit(first) + F.floor(place / per_word).cast("int"))
    bit = F.call_function("shiftright", word, place % per_word).bitwiseAND(F.lit(1).cast("bigint"))
    return F.coalesce(bit == 1, F.lit(False))


@dataclass(frozen=True)
class TimeWindow:
    """Query ends per dimension as columns; ``None`` leaves a dimension out of the plan.

    A dimension whose two ends are not both given (or not both non-null) is switched off.
    ``listed`` names the dimensions whose given ends are known to be whole numbers on their axis; where the
    table has truth bitmaps (``truth``) these are answered by a shift.
    """

    hour: tuple[Column, Column] | None = None
    day: tuple[Column, Column] | None = None
    month: tuple[Column, Column] | None = None
    listed: frozenset[str] = frozenset()

    @staticmethod
    def literal(hour=None, day=None, month=None) -> "TimeWindow":
        def ends(pair):
            if pair is None or pair[0] is None or pair[1] is None:
                return None
            return F.lit(float(pair[0])), F.lit(float(pair[1]))

        given = {"day": (day, 7), "month": (month, 12)}
        listed = frozenset(
            name
            for name, (pair, size) in given.items()
            if ends(pair) is not None and all(1 <= v <= size and v == int(v) for v in pair)
        )
        return TimeWindow(ends(hour), ends(day), ends(month), listed)

    @staticmethod
    def columns(prefix: str = "", listed: frozenset[str] = frozenset()) -> "TimeWindow":
        """The window held by the columns of a queries table."""
        def ends(name):
            return F.col(f"{prefix}{name}_start"), F.col(f"{prefix}{name}_end")

        return TimeWindow(ends("hour"), ends("day"), ends("month"), listed)

    def dimensions(self):
        named = (
            ("hour_ranges", self.hour, HOURS),
            ("day_ranges", self.day, DAYS),
            ("month_ranges", self.month, MONTHS),
        )
        return [(name, ends, base) for name, ends, base in named if ends is not None]

    def is_listed(self, name: str) -> bool:
        return name.removesuffix("_ranges") in self.listed


def listed_dimensions(queries: DataFrame) -> frozenset[str]:
    """The dimensions of a queries table whose ends are all on their axis, where given; one aggregate."""
    def on_axis(name: str, size: int) -> Column:
        held = F.lit(True)
        for end in (f"{name}_start", f"{name}_end"):
            held = held & (F.col(end).isNull() | F.col(end).cast("double").isin(*map(float, range(1, size + 1))))
        return F.coalesce(F.bool_and(held), F.lit(True)).alias(name)

    found = queries.agg(on_axis("day", 7), on_axis("month", 12)).first()
    return frozenset(name for name in ("day", "month") if found[name])


def _given(ends: tuple[Column, Column]) -> Column:
    return ends[0].isNotNull() & ends[1].isNotNull()


_TRUTH = {"day_ranges": ("day_truth", 7), "month_ranges": ("month_truth", 12)}


def in_force(window: TimeWindow, strict: bool = False, truth: bool = False) -> Column:
    """OR over the ranges of a dimension, AND over dimensions.

    Reads the columns ``hour_ranges``, ``day_ranges`` and ``month_ranges``, and with ``truth`` for listed
    dimensions ``day_truth`` and ``month_truth``. A dimension without ranges or without a query never excludes.
    """
    result = F.lit(True)
    for name, ends, base in window.dimensions():
        ranges = F.col(name)
        if truth and window.is_listed(name):
            column, size = _TRUTH[name]
            hit = truth_bit(F.col(column), ends, size, "any", strict)
        else:
            hit = any_within(*ends, ranges, base, strict)
        result = result & (~_given(ends) | is_empty(ranges) | hit)
    return result


def matches(
    window: TimeWindow, not_in_range: Column, strict: bool = False, truth: bool = False
) -> Column:
    """``in_force`` XOR ``not_in_range``."""
    return in_force(window, strict, truth) != not_in_range


def matches_all(
    window: TimeWindow, not_in_range: Column, strict: bool = False, truth: bool = False
) -> Column:
    """The stricter filter: every range of a queried dimension must pass.

    A code without any range fails, and so does one with a chained range (three or more
    members) in a queried day or month dimension.
    """
    has_range = (
        ~is_empty(F.col("hour_ranges"))
        | ~is_empty(F.col("day_ranges"))
        | ~is_empty(F.col("month_ranges"))
    )
    chained = {"day_ranges": F.col("chained_days"), "month_ranges": F.col("chained_months")}
    result = has_range
    for name, ends, base in window.dimensions():
        if truth and window.is_listed(name):
            column, size = _TRUTH[name]
            bitmaps = F.col(column)
            passed = F.col(name).isNotNull() & F.when(
                not_in_range, ~truth_bit(bitmaps, ends, size, "any", strict)
            ).otherwise(truth_bit(bitmaps, ends, size, "all", strict))
        else:
            passed = all_within(*ends, F.col(name), base, not_in_range, strict)
        if name in chained:
            passed = ~chained[name] & passed
        result = result & (~_given(ends) | passed)
    return result

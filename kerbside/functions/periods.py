"""Scalars and predicates of metered periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions.intervals import DAYS, HOURS, any_within, within

# Weekday columns of the periods table, Monday first, and their labels.
WEEKDAY_COLUMNS = ("bLun", "bMar", "bMer", "bJeu", "bVen", "bSam", "bDim")
WEEKDAY_LABELS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def clock_hours(text: Column, keep_seconds: bool = False) -> Column:
    """``HH:MM:SS`` as hours; seconds are ignored unless asked for."""
    hours = F.substring(text, 1, 2).cast("double") + F.substring(text, 4, 2).cast(
        "double"
    ) / F.lit(60.0)
    if keep_seconds:
        hours = hours + F.substring(text, 7, 2).cast("double") / F.lit(3600.0)
    return hours


def weekday_mask(columns=WEEKDAY_COLUMNS) -> Column:
    """Seven 0/1 columns as a bitmask: bit 0 is Monday, bit 6 is Sunday."""
    mask = F.lit(0).cast("bigint")
    for bit, name in enumerate(columns):
        mask = mask + F.col(name).cast("bigint") * F.lit(1 << bit)
    return mask


def mask_day_ranges(mask: Column) -> Column:
    """Contiguous weekday spans of a mask, ascending; Sunday does not run on to Monday."""
    padded = mask * 2  # bit d is now weekday d, and bits 0 and 8 are never set

    def on(day: Column) -> Column:
        return F.getbit(padded, day) == 1

    days = F.sequence(F.lit(1), F.lit(7))
    opens = F.filter(days, lambda d: on(d) & ~on(d - 1))
    closes = F.filter(days, lambda d: on(d) & ~on(d + 1))
    return F.transform(
        F.arrays_zip(opens.alias("start"), closes.alias("end")),
        lambda r: F.struct(
            r["start"].cast("bigint").alias("start"), r["end"].cast("bigint").alias("end")
        ),
    )


def needed_days(day_start: Column, day_end: Column) -> Column:
    """Mask of the queried days, for whole weekdays 1 to 7 in ascending order; otherwise null."""
    first, last = day_start.cast("bigint"), day_end.cast("bigint")
    ordinary = (
        (first == day_start) & (last == day_end)
        & (first >= 1) & (last <= 7) & (first <= last)
    )

    def power(bit: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))

    return F.when(ordinary, power(last) - power(first - 1))


def mask_covers(
    mask: Column, day_start: Column, day_end: Column, needed: Column | None = None
) -> Column:
    """Whether one weekday span of the mask contains the queried days.

    Ordinary days lie inside one span exactly when all their bits are set; every other query
    goes through the spans themselves. ``needed`` is ``needed_days`` of the query, for a
    caller that has it as a column already.
    """
    if needed is None:
        needed = needed_days(day_start, day_end)
    return F.when(needed.isNotNull(), mask.bitwiseAND(needed) == needed).otherwise(
        any_within(day_start, day_end, mask_day_ranges(mask), DAYS)
    )


def period_covers(
    period: Column, hour: tuple[Column, Column], day: tuple[Column, Column],
    strict: bool = False, needed: Column | None = None,
) -> Column:
    """Whether a period is being metered over the whole query window."""
    hit = mask_covers(period["weekday_mask"], *day, needed) & within(
        *hour, period["start_hour"], period["end_hour"], HOURS, strict
    )
    return F.coalesce(hit, F.lit(False))


def covering(periods: Column) -> Column:
    """The list with the fields that ``period_covers`` reads only."""
    names = ("start_hour", "end_hour", "weekday_mask")
    return F.transform(periods, lambda p: F.struct(*[p[name].alias(name) for name in names]))


def is_free(
    periods: Column,
    hour: tuple[Column, Column] | None,
    day: tuple[Column, Column] | None,
    strict: bool = False,
    needed: Column | None = None,
) -> Column:
    """Free when no period covers the window; always true unless hours and days are given."""
    if hour is None or day is None:
        return F.lit(True)
    given = (
        hour[0].isNotNull() & hour[1].isNotNull() & day[0].isNotNull() & day[1].isNotNull()
    )
    paid = F.coalesce(
        F.exists(periods, lambda p: period_covers(p, hour, day, strict, needed)), F.lit(False)
    )
    return ~(given & paid)


def descriptions(periods: Column) -> Column:
    """Distinct descriptions in order of first appearance; a null list gives none."""
    texts = F.transform(periods, lambda p: p["description"])
    return F.array_distinct(F.coalesce(texts, F.array().cast("array<string>")))


def period_label(mask: Column, start_time: Column, end_time: Column) -> Column:
    """``mon,tue: 09:00:00-18:00:00``; empty when no weekday is set."""
    days = F.concat_ws(
        ",",
        *[
            F.when(F.getbit(mask, F.lit(bit)) == 1, label)
            for bit, label in enumerate(WEEKDAY_LABELS)
        ],
    )
    return F.when(days == "", "").otherwise(F.concat(days, F.lit(": "), start_time, F.lit("-"), end_time))

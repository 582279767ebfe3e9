"""French regulation text to typed hour, weekday and month ranges, category and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# French weekday and month names and their abbreviations.
DAY_NAMES = {
    "lundi": 1, "mardi": 2, "mercredi": 3, "jeudi": 4, "vendredi": 5, "samedi": 6, "dimanche": 7,
}
DAY_ABBREVIATIONS = {"lun": 1, "mar": 2, "mer": 3, "jeu": 4, "ven": 5, "sam": 6, "dim": 7}
MONTH_NAMES = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7,
    "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
}
MONTH_ABBREVIATIONS = {
    "jan": 1, "fev": 2, "mar": 3, "avril": 4, "avr": 4, "mai": 5, "juin": 6, "juil": 7,
    "aout": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
CONNECTORS = ("au", "a")
SEPARATOR = "et"
HOUR_SPAN = r"\d{1,2}h\d{0,2}-\d{1,2}h\d{0,2}"

# A weekday keeps its number, a month is moved up by this much, a connector is 0.
_MONTH_SHIFT = 100

# Words that name both a day and a month (MAR) are days.
_WORD_NUMBERS = (
    {word: 0 for word in CONNECTORS}
    | {w: n + _MONTH_SHIFT for w, n in {**MONTH_NAMES, **MONTH_ABBREVIATIONS}.items()}
    | DAY_NAMES
    | DAY_ABBREVIATIONS
)
_WORD = r"(?iU)\b(?:" + "|".join(sorted(_WORD_NUMBERS)) + r")\b"

_RANGE = "struct<start:bigint,end:bigint,members:bigint>"


def hour_ranges(text: Column, ignore_case: bool = False) -> Column:
    """Every ``8h30-11h30`` span, left to right, as ``array<struct<start,end>>`` of hours.

    An end below its start is an overnight span. ``ignore_case`` also accepts ``9H-17H``.
    """
    spans = F.regexp_extract_all(
        text, F.lit(("(?i)" if ignore_case else "") + HOUR_SPAN), F.lit(0)
    )

    def hours(whole: Column, minutes: Column) -> Column:
        return whole.cast("double") + F.when(minutes == "", F.lit(0.0)).otherwise(
            minutes.cast("double") / F.lit(60.0)
        )

    def to_range(span: Column) -> Column:
        part = F.split(span, "[hH-]")
        return F.struct(
            hours(part[0], part[1]).alias("start"), hours(part[2], part[3]).alias("end")
        )

    return F.transform(spans, to_range)


def word_numbers(text: Column) -> Column:
    """Day, month and connector words of the text as numbers, in order; ``ET`` is left out.

    Word boundaries follow Unicode, so ``PRÉAU`` holds no ``AU``.
    """
    lookup = F.create_map(*[F.lit(x) for pair in _WORD_NUMBERS.items() for x in pair])
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    return F.transform(words, lambda word: F.element_at(lookup, F.lower(word)))


def day_month_ranges(text: Column) -> Column:
    """Struct of ``days`` and ``months``, each ``array<struct<start,end,members>>``.

    A day or month word opens a range of its own, unless the word before it is a connector
    (``A``, ``AU``) and its dimension already has a range: then it becomes that range's new
    end. ``members`` counts the words merged into the range.
    """
    empty = F.array().cast(f"array<{_RANGE}>")
    start = F.struct(
        empty.alias("days"), empty.alias("months"), F.lit(False).alias("joined")
    )

    def place(ranges: Column, number: Column, joined: Column) -> Column:
        opened = F.concat(ranges, F.array(_range(number, number, F.lit(1))))
        last = F.element_at(ranges, -1)
        extended = F.concat(
            F.slice(ranges, F.lit(1), F.size(ranges) - 1),
            F.array(_range(last["start"], number, last["members"] + 1)),
        )
        return F.when(joined & (F.size(ranges) > 0), extended).otherwise(opened)

    def step(seen: Column, number: Column) -> Column:
        is_day = number.between(1, _MONTH_SHIFT - 1)
        is_month = number > _MONTH_SHIFT
        return F.struct(
            F.when(is_day, place(seen["days"], number, seen["joined"]))
            .otherwise(seen["days"]).alias("days"),
            F.when(is_month, place(seen["months"], number - _MONTH_SHIFT, seen["joined"]))
            .otherwise(seen["months"]).alias("months"),
            (number == 0).alias("joined"),
        )

    return F.aggregate(word_numbers(text), start, step)


def _range(start: Column, end: Column, members: Column) -> Column:
    return F.struct(
        start.cast("bigint").alias("start"),
        end.cast("bigint").alias("end"),
        members.cast("bigint").alias("members"),
    )


def plain_ranges(ranges: Column) -> Column:
    """Drop the member counts."""
    return F.transform(
        ranges, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))
    )


def has_chain(ranges: Column) -> Column:
    """Whether some range was written with three or more members."""
    return F.exists(ranges, lambda r: r["members"] > 2)


def category(text: Column) -> Column:
    r"""``\P`` permits, ``\A`` prohibits, anything else is other; leading blanks are skipped."""
    marked = F.regexp_replace(text, r"(?U)^\s+", "")
    return (
        F.when(marked.startswith("\\P"), "permitted")
        .when(marked.startswith("\\A"), "prohibited")
        .otherwise("other")
    )


def is_reserved(text: Column) -> Column:
    """Whether the text holds RESERVE in any case; the accented spelling does not count."""
    return F.upper(text).contains("RESERVE")

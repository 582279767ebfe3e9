"""Which signs are (or are not) in force inside an area during a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import flat_ranges
from kerbside.functions.grid import Grid
from kerbside.functions.intervals import TimeWindow, listed_dimensions, matches, matches_all
from kerbside.operators.tiles import TiledBoxes
from kerbside.operators.time_index import TimeIndex
from kerbside.operators.viewport import in_bbox, in_categories
from kerbside.plans.requests import SignQuery

_RANGES = ("hour_ranges", "day_ranges", "month_ranges", "chained_days", "chained_months")
_TRUTH = ("day_truth", "month_truth")
_BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
_TESTS = {"any": matches, "all": matches_all}
_FLAT_TESTS = {"any": flat_ranges.matches, "all": flat_ranges.matches_all}

# Signs that a batch query lists together at most.
SIGNS_PER_LIST = 256

# Descriptions of permitted signs, and of those without a reservation.
PERMITTED = r"^\\P"
PERMITTED_UNRESERVED = r"^\\P(?!.*RESERVE).+"


def _has_truth(codes: DataFrame) -> bool:
    return all(name in codes.columns for name in _TRUTH)


def matching_codes(
    codes: DataFrame, query: SignQuery, mode: str = "any", strict: bool = False,
    regex: str | None = None,
) -> DataFrame:
    """Codes that pass the time filter, and the case-insensitive description pattern."""
    if regex is not None:
        codes = codes.where(F.col("description").rlike("(?i)" + regex))
    return codes.where(_TESTS[mode](query.window(), F.lit(query.not_in_range), strict, _has_truth(codes)))


def query_signs(
    signs: DataFrame,
    codes: DataFrame,
    query: SignQuery,
    mode: str = "any",
    strict: bool = False,
    regex: str | None = None,
) -> DataFrame:
    """Signs of the viewport with their description.

    The time filter runs on the code dictionary; the box and the categories are pushed into
    the scan of the signs. Every sign's code is in the dictionary, so the join both filters
    by code and looks up the description. ``categories=None`` leaves that filter out.
    """
    found = signs.where(in_bbox(query.bbox))
    if query.categories is not None:
        found = found.where(in_categories(query.categories))
    if query.reserved is not None:
        found = found.where(F.col("is_reserved") == F.lit(query.reserved))
    passing = matching_codes(codes, query, mode, strict, regex)
    return found.join(passing.select("code_id", "description"), "code_id").select(
        "sign_id",
        "longitude",
        "latitude",
        "category",
        "is_reserved",
        "arrondissement",
        "description",
    )


def _in_time(meet, codes: DataFrame, boxes: DataFrame, mode: str, strict: bool) -> DataFrame:
    """The pairs whose code passes the window of their query."""
    truth = _TRUTH if _has_truth(codes) else ()
    listed = listed_dimensions(boxes) if truth else frozenset()
    ranged = flat_ranges.ranged_axes(codes, listed)
    if flat_ranges.is_flat(ranged):
        of_codes = codes.select("code_id", "description", *flat_ranges.code_columns(ranged, mode, strict))

        def asked(tiled: DataFrame) -> DataFrame:
            window = flat_ranges.query_columns(ranged)
            return tiled.select("_tile", *_BOX, "query_id", "categories", "reserved", *window)

        return meet(of_codes, asked).where(_FLAT_TESTS[mode](ranged, strict))
    negate = F.coalesce("not_in_range", F.lit(False))
    pairs = meet(codes.select("code_id", "description", *_RANGES, *truth))
    return pairs.where(_TESTS[mode](TimeWindow.columns(listed=listed), negate, strict, bool(truth)))


def query_signs_batch(
    queries: DataFrame,
    signs: DataFrame,
    codes: DataFrame,
    grid: Grid | None = None,
    mode: str = "any",
    strict: bool = False,
    time_index: TimeIndex | None = None,
) -> DataFrame:
    """Answers of many query rows by one job: one row per (query_id, sign).

    Signs get what their code says first and meet the boxes through tiles, in lists of neighbours; the exact box,
    category and reservation tests and the window are tests of the pair. What is shuffled follows the signs and the
    boxes, and no pair of them is; queries never meet the whole dictionary.

    Where many queries share few time signatures, ``time_index`` finds the codes of each signature once, as
    words of bits, and a pair only looks up its bit. Only with more than ``MOST_SIGNATURES`` of them are pairs
    shuffled.
    """
    queries = queries.withColumn(
        "categories", F.coalesce("categories", F.array(F.lit("permitted")))
    ).where(F.size("categories") > 0)
    tiled = TiledBoxes(queries, grid)
    signs = signs.drop("fleche")
    described = codes.select("code_id", "description")

    def meet(of_codes: DataFrame, asked=None) -> DataFrame:
        points = signs.join(of_codes, "code_id")
        near = F.expr(f"sign_id div {SIGNS_PER_LIST}")  # numbers follow the tiles
        return (
            tiled.meet_listed(points, near, asked)
            .where(F.array_contains("categories", F.col("category")))
            .where(F.col("reserved").isNull() | (F.col("reserved") == F.col("is_reserved")))
        )

    if time_index is not None:
        lookup = time_index.lookup(tiled.boxes, mode, strict)
        if lookup.numbered is None:
            passing = lookup.passing_pairs(meet(described).drop(*_BOX, "categories", "reserved"))
        else:
            passing = meet(described.join(lookup.codes, "code_id"), lookup.with_number).where(lookup.is_match())
    else:
        passing = _in_time(meet, codes, tiled.boxes, mode, strict)
    return passing.select(
        "query_id",
        "sign_id",
        "longitude",
        "latitude",
        "category",
        "is_reserved",
        "arrondissement",
        "description",
    )

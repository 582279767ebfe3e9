"""Single query records."""

from __future__ import annotations

from dataclasses import dataclass

from kerbside.functions.intervals import TimeWindow
from kerbside.operators.viewport import BBox

Ends = tuple[float | None, float | None]


@dataclass(frozen=True)
class SpotQuery:
    """A viewport and an optional window; a pair with one end missing is switched off."""

    bbox: BBox
    hour: Ends | None = None
    day: Ends | None = None
    month: Ends | None = None

    @classmethod
    def from_parameters(
        cls, min_lon: float, min_lat: float, max_lon: float, max_lat: float,
        hour_start: float | None = None, hour_end: float | None = None,
        day_start: int | None = None, day_end: int | None = None,
        month_start: int | None = None, month_end: int | None = None,
        **others,
    ):
        """A query from flat request parameters."""
        return cls(
            (min_lon, min_lat, max_lon, max_lat),
            (hour_start, hour_end), (day_start, day_end), (month_start, month_end), **others,
        )

    def window(self) -> TimeWindow:
        return TimeWindow.literal(self.hour, self.day, self.month)


@dataclass(frozen=True)
class SignQuery(SpotQuery):
    """``reserved``: None keeps all signs, True only reserved ones, False the others."""

    categories: tuple[str, ...] | None = ("permitted",)
    reserved: bool | None = None
    not_in_range: bool = False

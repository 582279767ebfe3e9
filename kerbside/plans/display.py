"""Colours and popups of markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fill colours.
PERMITTED, PROHIBITED, OTHER = "#2563eb", "#dc2626", "#9ca3af"
FREE, PAID = "#16a34a", "#f59e0b"


def sign_color(category: Column) -> Column:
    return (
        F.when(category == "permitted", PERMITTED)
        .when(category == "prohibited", PROHIBITED)
        .otherwise(OTHER)
    )


def spot_color(is_currently_free: Column) -> Column:
    return F.when(is_currently_free, FREE).otherwise(PAID)


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def sign_popup(category: Column, description: Column) -> Column:
    return F.concat(
        F.lit('<b class="capitalize">'), category, F.lit("</b><br>"), escape_html(description)
    )


def spot_popup(is_currently_free: Column, street: Column, periods: Column) -> Column:
    """Status, street if known, and one line per period description."""
    status = F.when(is_currently_free, "Free now").otherwise("Paid now")
    has_street = F.coalesce(street, F.lit("")) != ""
    lines = F.array_join(F.transform(periods, escape_html), "<br>")
    has_lines = F.coalesce(lines, F.lit("")) != ""
    return F.concat(
        F.lit("<b>"),
        status,
        F.lit("</b>"),
        F.when(has_street, F.concat(F.lit("<br>"), escape_html(street))).otherwise(""),
        F.when(has_lines, F.concat(F.lit("<hr>"), lines)).otherwise(""),
    )

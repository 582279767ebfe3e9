"""The three marker layers of one map view: signs, paid spots and free spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.plans.requests import SignQuery, SpotQuery
from kerbside.plans.signs import PERMITTED, PERMITTED_UNRESERVED, query_signs
from kerbside.plans.spots import query_spots, spot_labels
from kerbside.sources.curated import Curated


def marker_layers(
    tables: Curated,
    query: SpotQuery,
    reserved: bool = False,
    not_in_range: bool = False,
    include_signs: bool = True,
    include_spots: bool = True,
) -> DataFrame:
    """Rows of (kind, latitude, longitude, label); kind is sign, paid or free.

    Signs are those marked as permitted, without reserved ones unless asked for, that pass
    the strict time filter. Spots are split by the window and carry their period labels,
    which are put together for the places of the view only.
    """
    layers = []
    if include_signs:
        asked = SignQuery(
            query.bbox, query.hour, query.day, query.month,
            categories=None, not_in_range=not_in_range,
        )
        pattern = PERMITTED if reserved else PERMITTED_UNRESERVED
        found = query_signs(
            tables.signs_near(query.bbox), tables.codes, asked, mode="all", regex=pattern
        )
        layers.append(
            found.select(
                F.lit("sign").alias("kind"),
                "latitude",
                "longitude",
                F.col("description").alias("label"),
            )
        )
    if include_spots:
        spots = query_spots(tables.spots_near(query.bbox), query).where(F.col("part_no") == 0)
        periods = tables.spot_periods.join(spots.select("place_id"), "place_id", "left_semi")
        kind = F.when(F.col("is_currently_free"), "free").otherwise("paid")
        layers.append(
            spots.join(spot_labels(periods), "place_id", "left").select(
                kind.alias("kind"),
                "latitude",
                "longitude",
                F.coalesce("label", F.lit("")).alias("label"),
            )
        )
    if not layers:
        return tables.signs.where(F.lit(False)).select(
            F.lit("").alias("kind"), "latitude", "longitude", F.lit("").alias("label")
        )
    result = layers[0]
    for layer in layers[1:]:
        result = result.unionByName(layer)
    return result

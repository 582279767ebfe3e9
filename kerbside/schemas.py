"""Declared schemas of the raw, curated and query tables."""

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    """A schema of nullable string columns, the form in which raw text files are read."""
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def _ranges(bound: T.DataType) -> T.ArrayType:
    return T.ArrayType(
        T.StructType([T.StructField("start", bound), T.StructField("end", bound)])
    )


RAW_SIGNS = strings(
    "CODE_RPA", "DESCRIPTION_RPA", "Longitude", "Latitude", "NOM_ARROND", "FLECHE_PAN"
)
RAW_PLACES = strings(
    "sNoPlace",
    "nPositionCentreLongitude",
    "nPositionCentreLatitude",
    "nTarifHoraire",
    "sType",
    "sNomRue",
)
RAW_PLACE_LINKS = strings("sNoEmplacement", "sCodeAutocollant")
RAW_PERIOD_LINKS = strings("sCode", "noPeriode", "sDescription")
RAW_PERIODS = strings(
    "nID", "dtHeureDebut", "dtHeureFin",
    "bLun", "bMar", "bMer", "bJeu", "bVen", "bSam", "bDim",
)
RAW_REGULATIONS = strings("Name", "Type", "DateDebut", "DateFin", "maxHeures")

CODES = T.StructType(
    [
        T.StructField("code_id", T.LongType()),
        T.StructField("code_rpa", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("is_reserved", T.BooleanType()),
        T.StructField("hour_ranges", _ranges(T.DoubleType())),
        T.StructField("day_ranges", _ranges(T.LongType())),
        T.StructField("month_ranges", _ranges(T.LongType())),
        # True when a range was written with three or more members (LUN A MER A VEN).
        T.StructField("chained_days", T.BooleanType()),
        T.StructField("chained_months", T.BooleanType()),
    ]
)
# The dictionary as stored: with bits for every query range of an axis, see functions.intervals.truth_bitmaps.
CODE_TABLE = T.StructType(
    [
        *CODES,
        T.StructField("day_truth", T.ArrayType(T.LongType())),
        T.StructField("month_truth", T.ArrayType(T.LongType())),
    ]
)

SIGNS = T.StructType(
    [
        T.StructField("sign_id", T.LongType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("arrondissement", T.StringType()),
        T.StructField("fleche", T.StringType()),
        T.StructField("code_id", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("is_reserved", T.BooleanType()),
    ]
)

PERIOD = T.StructType(
    [
        T.StructField("start_hour", T.DoubleType()),
        T.StructField("end_hour", T.DoubleType()),
        T.StructField("weekday_mask", T.LongType()),
        T.StructField("description", T.StringType()),
        # how many links the period stands for
        T.StructField("n_links", T.LongType()),
    ]
)

# One row per spot, except that a spot with a very long period list spans several
# rows: part_no tells them apart, 0 being always there, and n_parts is their number at most.
SPOTS = T.StructType(
    [
        T.StructField("place_id", T.StringType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("tariff_hourly", T.DoubleType()),
        T.StructField("spot_type", T.StringType()),
        T.StructField("street", T.StringType()),
        T.StructField("periods", T.ArrayType(PERIOD)),
        T.StructField("part_no", T.LongType()),
        T.StructField("n_parts", T.LongType()),
    ]
)

# One row per distinct metered period of a spot; n_links counts the link rows behind it.
SPOT_PERIODS = T.StructType(
    [
        T.StructField("place_id", T.StringType()),
        T.StructField("first_period", T.LongType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("start_hour", T.DoubleType()),
        T.StructField("end_hour", T.DoubleType()),
        T.StructField("weekday_mask", T.LongType()),
        T.StructField("description", T.StringType()),
        T.StructField("n_links", T.LongType()),
    ]
)

QUERIES = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("min_lon", T.DoubleType()),
        T.StructField("min_lat", T.DoubleType()),
        T.StructField("max_lon", T.DoubleType()),
        T.StructField("max_lat", T.DoubleType()),
        T.StructField("hour_start", T.DoubleType()),
        T.StructField("hour_end", T.DoubleType()),
        T.StructField("day_start", T.LongType()),
        T.StructField("day_end", T.LongType()),
        T.StructField("month_start", T.LongType()),
        T.StructField("month_end", T.LongType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("reserved", T.BooleanType()),
        T.StructField("not_in_range", T.BooleanType()),
    ]
)

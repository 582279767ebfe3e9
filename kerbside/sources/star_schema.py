"""Raw regulation tables derived from the star-schema test tables by integer arithmetic.

The test tables hold no parking data; these projections give every row of them a place in
the raw tables the municipality publishes, all strings, with the same edge cases: unmarked
and null texts, overnight and chained ranges, missing coordinates, unmatched links, empty
weekday masks, ends at 23:59:59 and tariffs that are not numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import moments
from kerbside.plans.build import RawTables

# Pieces of the sign texts; each is chosen by its own remainder of the part key.
MARKERS = ["\\P ", "\\A ", "  \\P ", "\\A RESERVE AUTOBUS ", "", "\\P RESERVE S3R ", "\\p "]
MINUTES = ["", "30", "15", "45"]
DAYS = [
    "", "LUN A VEN", "LUN AU VEN", "MARDI VENDREDI", "MAR ET JEU", "SAM DIM",
    "LUN A MER A VEN", "MERCREDI", "SAMEDI A LUNDI", "mar. au jeu.", "DIMANCHE",
    "LUN MER VEN", "VEN A DIM", "LUNDI ET MARDI A JEUDI", "ECOLE", "JEU A MAR",
]
MONTHS = [
    "", "1 AVRIL AU 1 DEC", "SEPT A JUIN", "1 AVR AU 1 DEC", "MARS A NOV", "JUIL AOUT",
    "15 MARS AU 15 NOV", "JANVIER A MARS A MAI", "DEC A MARS", "OCTOBRE ET NOV A AVRIL",
]
SUFFIXES = ["", " EXCEPTE TAXIS", " LIVRAISON SEULEMENT", " reserve handicapes", " MARCHE AUTOBUS"]
HOUR_FORMS = 8

# Smallest coordinates and extents, in units of 1e-5 degrees.
LON_UNITS, LON_SPAN = 7397000, 49000  # west of Greenwich
LAT_UNITS, LAT_SPAN = 4541000, 29000
BOX_SIZES = [100, 300, 800]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def table_paths(folder: str, *names: str) -> list[str]:
    return [f"{folder.rstrip('/')}/{name}.parquet" for name in names]


def _pick(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by))


def _two_digits(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def _units_text(units: Column) -> Column:
    """A positive number of 1e-5 units as decimal text."""
    return F.concat(
        _div(units, 100000).cast("string"),
        F.lit("."),
        F.lpad((units % 100000).cast("string"), 5, "0"),
    )


def _lon_text(offset: Column) -> Column:
    return F.concat(F.lit("-"), _units_text(F.lit(LON_UNITS) - offset))


def _lat_text(offset: Column) -> Column:
    return _units_text(F.lit(LAT_UNITS) + offset)


def description(key: Column) -> Column:
    """Sign text of a part key."""
    first, second = (key * 5) % 24, (key * 11 + 3) % 24
    minutes = _pick(MINUTES, _div(key, 3) % len(MINUTES))
    form = _div(key, 7) % HOUR_FORMS

    def hour(value: Column) -> Column:
        return value.cast("string")

    hours = (
        F.when(form == 1, F.concat(hour(first), F.lit("h-"), hour(second), F.lit("h")))
        .when(form == 2, F.concat(_two_digits(first), F.lit("h30-"), hour(second), F.lit("h")))
        .when(
            form == 3,
            F.concat(hour(first), F.lit("h"), minutes, F.lit("-"), hour(second), F.lit("h"), minutes),
        )
        .when(form == 4, F.lit("07h-19h CLIGNOTANT 22h-07h FIXE"))
        .when(form == 5, F.concat(hour(first), F.lit("H-"), hour(second), F.lit("H")))
        .when(form == 6, F.lit("EN TOUT TEMPS"))
        .when(
            form == 7,
            F.concat(
                _two_digits(first), F.lit("h-"), _two_digits(second), F.lit("h"), minutes,
                F.lit(" 13h-15h30"),
            ),
        )
        .otherwise("")
    )
    text = F.concat(
        _pick(MARKERS, key % len(MARKERS)),
        hours,
        F.lit(" "),
        _pick(DAYS, _div(key, 3) % len(DAYS)),
        F.lit(" "),
        _pick(MONTHS, _div(key, 11) % len(MONTHS)),
        _pick(SUFFIXES, _div(key, 13) % len(SUFFIXES)),
    )
    return F.when(key % 53 != 7, text)


def raw_signs(spark: SparkSession, folder: str) -> DataFrame:
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    line, supplier = F.col("l_linenumber"), F.col("l_suppkey")
    return table(spark, folder, "lineitem").select(
        F.when(order % 97 != 0, F.concat(F.lit("C"), part)).alias("CODE_RPA"),
        description(part).alias("DESCRIPTION_RPA"),
        F.when(order % 89 != 1, _lon_text((order * 7919 + line * 101) % LON_SPAN)).alias("Longitude"),
        _lat_text((supplier * 4801 + order) % LAT_SPAN).alias("Latitude"),
        F.when(supplier % 19 != 0, F.concat(F.lit("Arrondissement "), supplier % 19)).alias("NOM_ARROND"),
        (line % 4).cast("string").alias("FLECHE_PAN"),
    )


def raw_periods(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    half = F.when(key % 2 == 0, "00").otherwise("30")
    start = F.concat(_two_digits((size * 7 + key) % 24), F.lit(":"), half, F.lit(":00"))
    end = F.concat(_two_digits((size * 3 + key * 5) % 24), F.lit(":"), half, F.lit(":00"))
    bits = [
        ((_div(key, 1 << bit)) % 2).cast("string").alias(name)
        for bit, name in enumerate(["bLun", "bMar", "bMer", "bJeu", "bVen", "bSam", "bDim"])
    ]
    return table(spark, folder, "part").select(
        key.cast("string").alias("nID"),
        start.alias("dtHeureDebut"),
        F.when(key % 10 == 3, "23:59:59").otherwise(end).alias("dtHeureFin"),
        *bits,
    )


def raw_period_links(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.concat(F.lit("R"), _div(key, 4)).alias("sCode"),
        key.cast("string").alias("noPeriode"),
        F.col("p_name").alias("sDescription"),
    )


def raw_place_links(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    prefix = F.when(key % 11 == 0, "X").otherwise("R")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("sNoEmplacement"),
        F.concat(prefix, _div(key, 30)).alias("sCodeAutocollant"),
    )


def raw_places(spark: SparkSession, folder: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    cents = (key * 37) % 600
    tariff = F.concat(_div(cents, 100), F.lit("."), _two_digits(cents % 100))
    return table(spark, folder, "customer").select(
        key.cast("string").alias("sNoPlace"),
        F.when(key % 101 != 50, _lon_text((key * 7919) % LON_SPAN)).alias("nPositionCentreLongitude"),
        _lat_text((key * 4801) % LAT_SPAN).alias("nPositionCentreLatitude"),
        F.when(key % 13 == 0, "N/A").when(key % 17 != 0, tariff).alias("nTarifHoraire"),
        F.col("c_mktsegment").alias("sType"),
        F.when(nation != 0, F.concat(F.lit("Rue <"), nation, F.lit("> & Cie"))).alias("sNomRue"),
    )


def raw_regulations(spark: SparkSession, folder: str) -> DataFrame:
    code = _div(F.col("p_partkey"), 4)
    return (
        table(spark, folder, "part")
        .where(code % 7 != 0)
        .select(
            F.concat(F.lit("R"), code).alias("Name"),
            F.lit("U").alias("Type"),
            F.lit("0101").alias("DateDebut"),
            F.lit("3112").alias("DateFin"),
            (code % 5).cast("string").alias("maxHeures"),
        )
        .distinct()
    )


def raw_tables(spark: SparkSession, folder: str) -> RawTables:
    return RawTables(
        signs=raw_signs(spark, folder),
        places=raw_places(spark, folder),
        place_links=raw_place_links(spark, folder),
        period_links=raw_period_links(spark, folder),
        periods=raw_periods(spark, folder),
        regulations=raw_regulations(spark, folder),
    )


def _box(key: Column, user: Column) -> list[Column]:
    west = (user * 7919 + key * 13) % LON_SPAN - LON_UNITS
    south = LAT_UNITS + (key * 4801) % LAT_SPAN
    size = F.element_at(F.array(*[F.lit(s) for s in BOX_SIZES]), (key % 3 + 1).cast("int"))
    return [
        (west / 100000.0).alias("min_lon"),
        (south / 100000.0).alias("min_lat"),
        ((west + size) / 100000.0).alias("max_lon"),
        ((south + size) / 100000.0).alias("max_lat"),
    ]


def query_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One query per event: a one-hour window from its moment, and a box from its keys."""
    key, user, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    hour = moments.hour_of_day(ts)
    later = F.when(hour >= 23.0, hour - 23.0).otherwise(hour + 1.0)
    day, month = moments.day_of_week(ts), moments.month_of_year(ts)
    return table(spark, folder, "events").select(
        key.alias("query_id"),
        *_box(key, user),
        F.when(key % 14 != 0, hour).alias("hour_start"),
        F.when(key % 7 != 0, later).alias("hour_end"),
        F.when(key % 8 != 0, day).alias("day_start"),
        F.when(key % 8 != 0, day).alias("day_end"),
        F.when(key % 2 == 0, month).alias("month_start"),
        F.when(key % 2 == 0, month).alias("month_end"),
        F.when(key % 40 == 7, F.array().cast("array<string>"))
        .when(key % 4 == 1, F.array(F.lit("permitted"), F.lit("prohibited")))
        .when(key % 4 == 2, F.array(F.lit("permitted"), F.lit("prohibited"), F.lit("other")))
        .when(key % 4 == 3, F.array(F.lit("permitted")))
        .alias("categories"),
        F.when(key % 5 == 1, F.lit(True)).when(key % 5 == 2, F.lit(False)).alias("reserved"),
        (key % 6 == 0).alias("not_in_range"),
    )


def filter_strings(spark: SparkSession, folder: str) -> DataFrame:
    """One saved filter per event: query_id, a box and a URL query string."""
    key = F.col("event_id")
    hour = F.hour("ts")

    def piece(condition: Column, *texts) -> Column:
        parts = [F.lit(t) if isinstance(t, str) else t.cast("string") for t in texts]
        return F.when(condition, F.concat(*parts))

    text = F.concat_ws(
        "&",
        piece(key % 3 != 0, "signs=1"),
        piece(key % 3 == 1, "spots=1"),
        piece(key % 9 == 3, "spots=0"),
        piece(key % 4 == 1, "cat=permitted%2Cprohibited"),
        piece(key % 4 == 2, "cat=other"),
        piece(key % 16 == 3, "cat="),
        piece(key % 5 == 1, "reserved=1"),
        piece(key % 5 == 2, "reserved=0"),
        piece(key % 7 == 1, "hour=", hour, "-", (hour + 2) % 24),
        piece(key % 7 == 2, "hour=", hour, ".5-", (hour + 5) % 24, ".25"),
        piece(key % 7 == 3, "hour=", hour),
        piece(key % 7 == 4, "hour=abc-", hour),
        piece(key % 7 == 5, "hour=+", hour, "+-%20", (hour + 3) % 24),
        piece(key % 8 == 1, "day=1-5"),
        piece(key % 8 == 2, "day=6-7-3"),
        piece(key % 8 == 3, "day=1.5-2"),
        piece(key % 6 == 1, "month=4-12"),
        piece(key % 6 == 2, "month=-3"),
        piece(key % 10 == 1, "not=1"),
        piece(key % 10 == 2, "not=true"),
        piece(key % 12 == 5, "signs=0"),
    )
    marked = F.when(key % 2 == 0, F.concat(F.lit("?"), text)).otherwise(text)
    return table(spark, folder, "events").select(
        key.alias("query_id"), marked.alias("query_string"), *_box(key, F.col("user_id"))
    )

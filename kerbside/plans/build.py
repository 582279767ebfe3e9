"""Batch build: raw all-string tables to the curated codes, signs and spots."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.functions import periods as P
from kerbside.functions import text_ranges as text
from kerbside.functions.grid import Grid
from kerbside.functions.intervals import truth_bitmaps
from kerbside.operators.lists import bounded_lists
from kerbside.operators.numbering import number_rows
from kerbside.sources import curated
from kerbside.sources.delimited import read_csv
from kerbside.sources.versions import new_version, publish
from kerbside.storage import intermediate_tables

# A spot with more distinct periods than this spans several curated rows.
PERIODS_PER_ROW = 1_000

# File names of the municipal tables.
RAW_FILES = {
    "signs": ("signalisation_stationnement.csv", schemas.RAW_SIGNS),
    "places": ("Places.csv", schemas.RAW_PLACES),
    "place_links": ("EmplacementReglementation.csv", schemas.RAW_PLACE_LINKS),
    "period_links": ("ReglementationPeriode.csv", schemas.RAW_PERIOD_LINKS),
    "periods": ("Periodes.csv", schemas.RAW_PERIODS),
    "regulations": ("Reglementations.csv", schemas.RAW_REGULATIONS),
}


@dataclass(frozen=True)
class RawTables:
    signs: DataFrame
    places: DataFrame
    place_links: DataFrame
    period_links: DataFrame
    periods: DataFrame
    regulations: DataFrame


def read_raw(spark: SparkSession, folder: str) -> RawTables:
    """The municipal CSV files of a folder."""
    return RawTables(
        **{
            name: read_csv(spark, f"{folder.rstrip('/')}/{file}", schema)
            for name, (file, schema) in RAW_FILES.items()
        }
    )


def parse_codes(pairs: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Typed ranges, category and flags of (code_rpa, description) rows."""
    found = pairs.withColumn("description", F.coalesce("description", F.lit(""))).withColumn(
        "_found", text.day_month_ranges(F.col("description"))
    )
    return found.select(
        *[name for name in pairs.columns],
        text.category(F.col("description")).alias("category"),
        text.is_reserved(F.col("description")).alias("is_reserved"),
        text.hour_ranges(F.col("description"), ignore_case).alias("hour_ranges"),
        text.plain_ranges(F.col("_found.days")).alias("day_ranges"),
        text.plain_ranges(F.col("_found.months")).alias("month_ranges"),
        text.has_chain(F.col("_found.days")).alias("chained_days"),
        text.has_chain(F.col("_found.months")).alias("chained_months"),
    )


def distinct_codes(raw_signs: DataFrame) -> DataFrame:
    """The (code_rpa, description) pairs in use."""
    return (
        raw_signs.select(
            F.col("CODE_RPA").alias("code_rpa"), F.col("DESCRIPTION_RPA").alias("description")
        )
        .dropna(subset=["code_rpa"])
        .distinct()
    )


def explode_ranges(codes: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """One row per range of a range column, with its position; ``keep_empty`` also keeps
    codes without ranges, with nulls.

    Empty lists are dropped after the outer explode. A plain explode would have the planner
    test the list's size first, and push that test, with all the parsing it needs, below
    the distinct step and onto every sign.
    """
    others = [name for name in codes.columns if name != column]
    rows = codes.select(*others, F.posexplode_outer(column).alias("pos", "_range"))
    if not keep_empty:
        rows = rows.where(F.col("pos").isNotNull())
    return rows.select(*others, F.col("pos").cast("bigint").alias("pos"), "_range.*")


def build_codes(raw_signs: DataFrame, ignore_case: bool = False) -> DataFrame:
    """The code dictionary: each distinct text is parsed once, however many signs carry it."""
    numbered = number_rows(distinct_codes(raw_signs), ["code_rpa", "description"], "code_id")
    parsed = parse_codes(numbered, ignore_case)
    return parsed.select(
        *parsed.columns,
        truth_bitmaps(F.col("day_ranges"), 7).alias("day_truth"),
        truth_bitmaps(F.col("month_ranges"), 12).alias("month_truth"),
    ).select(*schemas.CODE_TABLE.names)


def build_signs(raw_signs: DataFrame, codes: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Signs with their code's attributes, numbered and laid out by tile.

    The one range shuffle serves both purposes: numbers follow the Z-order of the tiles, so
    a viewport meets few files and row groups. Copies of one sign, however many, are told
    apart by their position in the raw scan and spread over partitions.

    ``codes`` should be a written table: the planner broadcasts it when its real size is
    below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins by shuffle, where
    adaptive execution splits the partitions of hot codes.
    """
    located = (
        raw_signs.dropna(subset=["CODE_RPA", "Longitude", "Latitude"])
        .select(
            F.monotonically_increasing_id().alias("_copy"),
            F.col("CODE_RPA").alias("code_rpa"),
            F.col("Longitude").cast("double").alias("longitude"),
            F.col("Latitude").cast("double").alias("latitude"),
            F.col("NOM_ARROND").alias("arrondissement"),
            F.col("FLECHE_PAN").alias("fleche"),
        )
    )
    attributes = codes.select("code_rpa", "code_id", "category", "is_reserved")
    signs = located.join(attributes, "code_rpa").withColumn(
        "cell", grid.cell(F.col("longitude"), F.col("latitude"))
    )
    order = ["cell", "longitude", "latitude", "code_id", "arrondissement", "fleche"]
    numbered = number_rows(signs, order, "sign_id", copy_column="_copy", slice_column=curated.SLICE)
    return numbered.select(*schemas.SIGNS.names, curated.SLICE)


def type_periods(raw_periods: DataFrame, keep_seconds: bool = False) -> DataFrame:
    """Periods with hours and weekday mask."""
    return raw_periods.select(
        "nID",
        F.col("dtHeureDebut").alias("start_time"),
        F.col("dtHeureFin").alias("end_time"),
        P.clock_hours(F.col("dtHeureDebut"), keep_seconds).alias("start_hour"),
        P.clock_hours(F.col("dtHeureFin"), keep_seconds).alias("end_hour"),
        P.weekday_mask().alias("weekday_mask"),
    )


def build_spot_periods(
    raw: RawTables, via_regulations: bool = False, keep_seconds: bool = False
) -> DataFrame:
    """The distinct metered periods of each place, with the number of links behind each.

    Both link tables are counted down to distinct rows before they meet, so repeated links
    of a hot place or a hot code are folded on the map side and never multiply.
    ``via_regulations`` keeps only codes that the regulations table names.
    """
    content = ["start_time", "end_time", "weekday_mask", "description"]
    code_periods = (
        raw.period_links.join(
            type_periods(raw.periods), F.col("noPeriode") == F.col("nID")
        )
        .withColumnRenamed("sDescription", "description")
        .groupBy("sCode", *content)
        .agg(
            F.min(F.col("noPeriode").try_cast("bigint")).alias("first_period"),
            F.count(F.lit(1)).alias("n_periods"),
        )
    )
    # links that name no place or no code can never reach a place
    links = raw.place_links.dropna(subset=["sNoEmplacement", "sCodeAutocollant"])
    place_codes = links.groupBy("sNoEmplacement", "sCodeAutocollant").agg(
        F.count(F.lit(1)).alias("n_places")
    )
    if via_regulations:
        # The link columns are joined as rows, so a name listed twice counts twice.
        names = raw.regulations.groupBy("Name").agg(F.count(F.lit(1)).alias("n_names"))
        place_codes = place_codes.join(names, F.col("sCodeAutocollant") == F.col("Name")).select(
            "sNoEmplacement",
            "sCodeAutocollant",
            (F.col("n_places") * F.col("n_names")).alias("n_places"),
        )
    return (
        place_codes.join(code_periods, F.col("sCodeAutocollant") == F.col("sCode"))
        .withColumnRenamed("sNoEmplacement", "place_id")
        .groupBy("place_id", *content)
        .agg(
            F.min("first_period").alias("first_period"),
            F.sum(F.col("n_places") * F.col("n_periods")).alias("n_links"),
        )
        .withColumn("start_hour", P.clock_hours(F.col("start_time"), keep_seconds))
        .withColumn("end_hour", P.clock_hours(F.col("end_time"), keep_seconds))
        .select(*schemas.SPOT_PERIODS.names)
    )


def type_places(raw_places: DataFrame) -> DataFrame:
    """Places with strict coordinates and a lenient tariff; unlocated places are dropped."""
    return raw_places.select(
        F.col("sNoPlace").alias("place_id"),
        F.col("nPositionCentreLongitude").cast("double").alias("longitude"),
        F.col("nPositionCentreLatitude").cast("double").alias("latitude"),
        F.col("nTarifHoraire").try_cast("double").alias("tariff_hourly"),
        F.col("sType").alias("spot_type"),
        F.col("sNomRue").alias("street"),
    ).dropna(subset=["longitude", "latitude"])


def build_spots(
    raw_places: DataFrame,
    spot_periods: DataFrame,
    how: str = "left",
    periods_per_row: int = PERIODS_PER_ROW,
    grid: Grid = Grid(),
) -> DataFrame:
    """Places with their period list, ordered by first period and description.

    Places without periods keep a null list under the default left join. ``spot_periods``
    should be a written table.
    """
    entry = F.struct(
        "first_period",
        "description",
        "start_hour",
        "end_hour",
        "weekday_mask",
        "start_time",
        "end_time",
        "n_links",
    )
    lists = bounded_lists(spot_periods, ["place_id"], entry, "entries", periods_per_row)
    per_place = lists.select(
        "place_id",
        "n_parts",
        "part_no",
        F.transform(
            "entries", lambda e: F.struct(*[e[name].alias(name) for name in schemas.PERIOD.names])
        ).alias("periods"),
    )
    spots = (
        type_places(raw_places)
        .join(per_place, "place_id", how)
        .withColumn("part_no", F.coalesce("part_no", F.lit(0).cast("bigint")))
        .withColumn("n_parts", F.coalesce("n_parts", F.lit(1).cast("bigint")))
        .withColumn("cell", grid.cell(F.col("longitude"), F.col("latitude")))
    )
    layout = ["cell", "place_id", "part_no"]
    return (
        spots.repartitionByRange(*layout)
        .sortWithinPartitions(*layout)
        .select(*schemas.SPOTS.names)
    )


def build(
    spark: SparkSession,
    raw: RawTables,
    folder: str,
    grid: Grid = Grid(),
    periods_per_row: int = PERIODS_PER_ROW,
    ignore_case: bool = False,
    via_regulations: bool = False,
    keep_seconds: bool = False,
) -> curated.Curated:
    """Write the curated tables to a new version of a folder, each from the written form of the one before,
    and publish it. Readers of earlier versions go on undisturbed.

    Signs and spots share no input, so the two chains are submitted side by side.
    ``via_regulations`` keeps only links the regulations table names, and only places that
    have periods; ``keep_seconds`` counts the seconds of period ends.
    """
    version = new_version(folder)

    def sign_tables():
        with intermediate_tables(spark):
            curated.write_table(build_codes(raw.signs, ignore_case), version, "codes")
            codes = curated.read_table(spark, version, "codes")
            curated.write_table(build_signs(raw.signs, codes, grid), version, "signs")
            curated.write_index(spark, version, "signs", grid)

    def spot_tables():
        with intermediate_tables(spark):
            periods = build_spot_periods(raw, via_regulations, keep_seconds)
            curated.write_table(periods, version, "spot_periods")
            spot_periods = curated.read_table(spark, version, "spot_periods")
            how = "inner" if via_regulations else "left"
            spots = build_spots(raw.places, spot_periods, how, periods_per_row, grid)
            curated.write_table(spots, version, "spots")
            curated.write_index(spark, version, "spots", grid)

    with ThreadPoolExecutor(max_workers=2) as pool:
        for chain in [pool.submit(sign_tables), pool.submit(spot_tables)]:
            chain.result()
    publish(spark, version)
    return curated.load(spark, version)

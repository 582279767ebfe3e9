"""One entry per operator; each takes (spark, folder) and returns flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.functions import moments
from kerbside.functions import periods as P
from kerbside.functions import text_ranges as text
from kerbside.functions.intervals import within
from kerbside.operators import clusters, viewport
from kerbside.operators.numbering import number_rows
from kerbside.operators.radius_clusters import radius_clusters
from kerbside.operators.time_index import TimeIndex
from kerbside.plans import build as B
from kerbside.plans import display, markers, report, saved_filters
from kerbside.plans import signs as S
from kerbside.plans import spots as SP
from kerbside.plans.prepared import curated_tables
from kerbside.plans.requests import SignQuery, SpotQuery
from kerbside.sources import delimited, geojson
from kerbside.sources import star_schema as inputs
from kerbside.sources.geojson_document import read_document, write_document
from kerbside.storage import new_path, written
from kerbside.streaming import status

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ALL_CATEGORIES = ("permitted", "prohibited", "other")
SMALL_BOX = (-73.57, 45.49, -73.55, 45.51)
WIDE_BOX = (-73.75, 45.45, -73.55, 45.60)


MARKER_VIEW = SpotQuery(WIDE_BOX, hour=(10, 11), day=(2, 2), month=(7, 7))


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _parsed(spark, folder, ignore_case: bool = False) -> DataFrame:
    return B.parse_codes(B.distinct_codes(inputs.raw_signs(spark, folder)), ignore_case)


# Text to ranges


def _hour_rows(codes: DataFrame) -> DataFrame:
    return B.explode_ranges(codes, "hour_ranges").select(
        "code_rpa", "pos", F.col("start").alias("start_hour"), F.col("end").alias("end_hour")
    )


@query
def codes_hour_ranges(spark, folder):
    return _hour_rows(_parsed(spark, folder))


@query
def hour_ranges_ignore_case(spark, folder):
    return _hour_rows(_parsed(spark, folder, ignore_case=True))


@query
def hour_ranges_exploded(spark, folder):
    rows = B.explode_ranges(_parsed(spark, folder), "hour_ranges", keep_empty=True)
    return rows.select(
        "code_rpa",
        "description",
        F.col("start").alias("start_hour"),
        F.col("end").alias("end_hour"),
    )


def _day_month(spark, folder, field: str) -> DataFrame:
    pairs = B.distinct_codes(inputs.raw_signs(spark, folder))
    found = pairs.select(
        "code_rpa", text.day_month_ranges(F.col("description"))[field].alias("ranges")
    )
    return B.explode_ranges(found, "ranges").select(
        "code_rpa",
        "pos",
        F.col("start").alias("range_start"),
        F.col("end").alias("range_end"),
        "members",
    )


@query
def codes_day_ranges(spark, folder):
    return _day_month(spark, folder, "days")


@query
def codes_month_ranges(spark, folder):
    return _day_month(spark, folder, "months")


@query
def codes_classify(spark, folder):
    return _parsed(spark, folder).select(
        "code_rpa", "description", "category", "is_reserved", "chained_days", "chained_months"
    )


# Build


@query
def codes_dictionary(spark, folder):
    pairs = B.distinct_codes(inputs.raw_signs(spark, folder))
    return number_rows(pairs, ["code_rpa", "description"], "code_id").select(
        "code_id", "code_rpa", "description"
    )


@query
def signs_curated(spark, folder):
    return curated_tables(spark, folder).signs


@query
def signs_report(spark, folder):
    return report.category_counts(curated_tables(spark, folder).signs)


@query
def quality_report(spark, folder):
    return report.quality_report(curated_tables(spark, folder))


@query
def period_scalars(spark, folder):
    raw = inputs.raw_periods(spark, folder)
    exact = B.type_periods(raw, keep_seconds=True).select(
        "nID", F.col("start_hour").alias("start_exact"), F.col("end_hour").alias("end_exact")
    )
    return B.type_periods(raw).select("nID", "start_hour", "end_hour", "weekday_mask").join(
        exact, "nID"
    )


@query
def mask_day_ranges(spark, folder):
    masks = B.type_periods(inputs.raw_periods(spark, folder)).select(
        "nID", "weekday_mask", F.posexplode(P.mask_day_ranges(F.col("weekday_mask")))
    )
    return masks.select(
        "nID",
        "weekday_mask",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("col.start").alias("start_day"),
        F.col("col.end").alias("end_day"),
    )


@query
def spot_periods(spark, folder):
    return B.build_spot_periods(inputs.raw_tables(spark, folder))


@query
def spots_curated(spark, folder):
    place = [n for n in schemas.SPOTS.names if n not in ("periods", "part_no", "n_parts")]
    return (
        curated_tables(spark, folder)
        .spots.select(*place, F.explode_outer("periods").alias("period"))
        .select(*place, "period.*")
    )


# Small enough for most places to span several curated rows.
SPLIT_PERIODS = 10


def _split_spots(spark, folder) -> DataFrame:
    raw = inputs.raw_tables(spark, folder)
    periods = curated_tables(spark, folder).spot_periods
    return written(B.build_spots(raw.places, periods, periods_per_row=SPLIT_PERIODS), "split-spots")


@query
def spots_split(spark, folder):
    """Periods of split spots, with the number of rows that stand for their place."""
    place = [n for n in schemas.SPOTS.names if n not in ("periods", "part_no", "n_parts")]
    spots = _split_spots(spark, folder)
    first = spots.where("part_no = 0").groupBy("place_id").agg(F.count(F.lit(1)).alias("n_first"))
    return (
        spots.select(*place, F.explode_outer("periods").alias("period"))
        .select(*place, "period.*")
        .join(first, "place_id", "left")
    )


@query
def batch_split_spots(spark, folder):
    answered = SP.query_spots_batch(inputs.query_rows(spark, folder), _split_spots(spark, folder))
    return _spot_rows(answered)


@query
def geojson_split_spots(spark, folder):
    """Features of split spots read back: those without a part, or with part 0, stand for a spot."""
    answered = SP.query_spots(_split_spots(spark, folder), SPOT_QUERIES["spot_query_free"])
    path = new_path(spark, "features")
    geojson.write_features(answered, geojson.spot_feature(), path)
    back = geojson.read_features(spark, path, geojson.SPOT_PART_PROPERTIES)
    return _spot_rows(back.withColumn("part_no", F.coalesce("part_no", F.lit(0))))


@query
def via_regulations(spark, folder):
    raw = inputs.raw_tables(spark, folder)
    periods = B.build_spot_periods(raw, via_regulations=True, keep_seconds=True)
    return B.type_places(raw.places).join(periods, "place_id").select(
        "place_id",
        "longitude",
        "latitude",
        "start_hour",
        "end_hour",
        "weekday_mask",
        "description",
        "n_links",
    )


@query
def csv_read(spark, folder):
    """The raw signs, through Windows-1252 files."""
    path = new_path(spark, "signs-csv")
    signs = inputs.raw_signs(spark, folder)
    (
        signs.select(*[delimited.to_latin(F.col(c)).alias(c) for c in signs.columns])
        .write.option("header", True)
        .option("encoding", "iso-8859-1")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return delimited.read_csv(spark, path, schemas.RAW_SIGNS)


# Interval predicates


@query
def interval_matrix(spark, folder):
    """Containment of a child range in a parent range, per line item, on all three axes."""
    order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    line = F.col("l_linenumber")
    axes = inputs.table(spark, folder, "lineitem").select(
        F.element_at(F.array(F.lit(24), F.lit(7), F.lit(12)), (line % 3 + 1).cast("int")).alias("base"),
        (order % 25).alias("qs"),
        (part % 25).alias("qe"),
        (supplier % 25).alias("ps"),
        ((order + part + line) % 25).alias("pe"),
    )
    bounds = [F.col(name).cast("double") for name in ("qs", "qe", "ps", "pe")]

    def on_axis(strict: bool):
        result = F.lit(None).cast("boolean")
        for base in (24, 7, 12):
            result = F.when(F.col("base") == base, within(*bounds, float(base), strict)).otherwise(result)
        return result

    return axes.groupBy("base", "qs", "qe", "ps", "pe").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "*", on_axis(False).alias("is_within"), on_axis(True).alias("is_within_strict")
    )


@query
def moment_query(spark, folder):
    return inputs.table(spark, folder, "events").select(
        "event_id",
        moments.hour_of_day(F.col("ts")).alias("hour"),
        moments.day_of_week(F.col("ts")).alias("day"),
        moments.month_of_year(F.col("ts")).alias("month"),
    )


# Single queries

SIGN_QUERIES: dict[str, tuple[SignQuery, dict]] = {
    "sign_query_time": (SignQuery(WIDE_BOX, hour=(22, 2)), {}),
    "sign_query_all_dimensions": (
        SignQuery(WIDE_BOX, hour=(10, 11), day=(1, 5), month=(5, 8), categories=ALL_CATEGORIES),
        {},
    ),
    "sign_query_not": (
        SignQuery(
            WIDE_BOX, hour=(20, 21), day=(1, 5), categories=("permitted", "prohibited"),
            not_in_range=True,
        ),
        {},
    ),
    "sign_query_not_alone": (SignQuery(WIDE_BOX, not_in_range=True), {}),
    "sign_query_reserved": (
        SignQuery(WIDE_BOX, hour=(8, 9), categories=ALL_CATEGORIES, reserved=True), {}
    ),
    "sign_query_unreserved": (
        SignQuery(WIDE_BOX, day=(6, 7), categories=ALL_CATEGORIES, reserved=False), {}
    ),
    "sign_query_bbox_only": (SignQuery(SMALL_BOX, categories=ALL_CATEGORIES), {}),
    "sign_query_half_window": (
        SignQuery(WIDE_BOX, hour=(9, None), day=(None, 3), month=(4, 4)), {}
    ),
    "sign_query_no_categories": (SignQuery(WIDE_BOX, categories=()), {}),
    "sign_query_regex": (
        SignQuery(WIDE_BOX, hour=(9, 10), categories=None), {"regex": S.PERMITTED_UNRESERVED}
    ),
    "sign_query_all_mode": (
        SignQuery(WIDE_BOX, hour=(10, 11), day=(2, 2), month=(7, 7), categories=None),
        {"mode": "all", "regex": S.PERMITTED},
    ),
    "sign_query_view": (
        SignQuery(WIDE_BOX, hour=(10, 11), day=(2, 2), month=(7, 7), categories=None),
        {"mode": "all", "regex": S.PERMITTED_UNRESERVED},
    ),
    "sign_query_view_not": (
        SignQuery(
            WIDE_BOX, hour=(10, 11), day=(2, 2), month=(7, 7), categories=None, not_in_range=True
        ),
        {"mode": "all", "regex": S.PERMITTED},
    ),
    "sign_query_all_mode_not": (
        SignQuery(WIDE_BOX, hour=(10, 11), day=(2, 2), categories=ALL_CATEGORIES, not_in_range=True),
        {"mode": "all"},
    ),
    "sign_query_strict": (
        SignQuery(WIDE_BOX, hour=(5, 23), categories=ALL_CATEGORIES), {"strict": True}
    ),
    "sign_query_quirk": (SignQuery(WIDE_BOX, hour=(5, 23), categories=ALL_CATEGORIES), {}),
}


def _sign_query(name: str) -> Query:
    return lambda spark, folder: _asked_signs(spark, folder, name)


for _name in SIGN_QUERIES:
    REGISTRY[_name] = _sign_query(_name)

SPOT_QUERIES: dict[str, SpotQuery] = {
    "spot_query_view": MARKER_VIEW,
    "spot_query_free": SpotQuery(WIDE_BOX, hour=(10, 11), day=(2, 2), month=(1, 1)),
    "spot_query_overnight": SpotQuery(WIDE_BOX, hour=(23, 1), day=(6, 7)),
    "spot_query_day_wrap": SpotQuery(WIDE_BOX, hour=(10, 10.5), day=(7, 1)),
    "spot_query_no_time": SpotQuery(WIDE_BOX, hour=(10, 11)),
}


def _spot_rows(answered: DataFrame) -> DataFrame:
    """One row per spot and description, in however many parts the spot was answered."""
    rows = answered.where((F.col("part_no") == 0) | (F.size("periods") > 0))
    described = rows.withColumn("description", F.explode_outer("periods"))
    return described.drop("periods", "part_no", "n_parts")


def _asked_signs(spark, folder, name: str) -> DataFrame:
    tables, (asked, options) = curated_tables(spark, folder), SIGN_QUERIES[name]
    return S.query_signs(tables.signs_near(asked.bbox), tables.codes, asked, **options)


def _asked_spots(spark, folder, name: str) -> DataFrame:
    asked = SPOT_QUERIES[name]
    return SP.query_spots(curated_tables(spark, folder).spots_near(asked.bbox), asked)


def _spot_query(name: str) -> Query:
    return lambda spark, folder: _spot_rows(_asked_spots(spark, folder, name))


for _name in SPOT_QUERIES:
    REGISTRY[_name] = _spot_query(_name)


@query
def spot_query_paid(spark, folder):
    answered = _asked_spots(spark, folder, "spot_query_free")
    paid = SP.split_spots(answered)[1]
    return paid.where("part_no = 0").select("place_id", "longitude", "latitude")


@query
def spot_labels(spark, folder):
    return SP.spot_labels(curated_tables(spark, folder).spot_periods)


# Batch queries


@query
def batch_sign_query(spark, folder):
    tables = curated_tables(spark, folder)
    return S.query_signs_batch(inputs.query_rows(spark, folder), tables.signs, tables.codes).select(
        "query_id", "sign_id", "category", "is_reserved", "description"
    )


@query
def batch_sign_query_all_mode(spark, folder):
    tables = curated_tables(spark, folder)
    return S.query_signs_batch(
        inputs.query_rows(spark, folder), tables.signs, tables.codes, mode="all"
    ).select("query_id", "sign_id")


@query
def batch_spot_query(spark, folder):
    answered = SP.query_spots_batch(
        inputs.query_rows(spark, folder), curated_tables(spark, folder).spots
    )
    return _spot_rows(answered)


# Streams

REPLAY_PARTS, LATE_HOURS = 3, 5


def _visits(spark, folder) -> DataFrame:
    """Moments at places: each user's events at one place."""
    return inputs.table(spark, folder, "events").select(
        (F.col("user_id") + 1).cast("string").alias("place_id"), F.col("ts").cast("timestamp").alias("at"), "event_id"
    )


@query
def place_changes(spark, folder):
    spots = curated_tables(spark, folder).spots
    return status.changes(status.place_statuses(_visits(spark, folder), spots))


@query
def place_changes_stream(spark, folder):
    """The same from a replayed file stream, in which each moment comes up to some hours late."""
    spots, late = curated_tables(spark, folder).spots, F.col("event_id") % (LATE_HOURS * 3600)
    visits = _visits(spark, folder).withColumn("arrival", F.unix_seconds("at") + late)
    first, last = visits.agg(F.min("arrival"), F.max("arrival")).first()
    width = (last - first) // REPLAY_PARTS + 1
    visits = visits.withColumn("part", F.floor((F.col("arrival") - first) / width))
    source, path, checkpoint = (new_path(spark, name) for name in ("visits", "changes", "state"))
    # a moment of another month lets the watermark pass all others
    ahead = visits.agg((F.max("at") + F.expr("interval 30 days")).alias("at")).select(F.lit("1").alias("place_id"), "at")
    for part in range(REPLAY_PARTS + 1):
        rows = visits.where(F.col("part") == part) if part < REPLAY_PARTS else ahead
        rows.select("place_id", "at").write.mode("append").parquet(source)
        stream = spark.readStream.schema("place_id string, at timestamp").parquet(source)
        statuses = status.place_statuses(stream, spots)
        status.write_changes(statuses, f"{LATE_HOURS + 1} hours", path, checkpoint).awaitTermination()
    return spark.read.schema(status.CHANGE).parquet(path)


# Saved filters

_FILTER_FIELDS = [
    "show_signs", "show_spots", "reserved", "hour_start", "hour_end", "day_start", "day_end",
    "month_start", "month_end", "not_in_range",
]


@query
def filter_decode(spark, folder):
    decoded = saved_filters.decode_filters(inputs.filter_strings(spark, folder))
    return decoded.select(
        "query_id", F.array_join("categories", "|").alias("categories"), *_FILTER_FIELDS
    )


@query
def filter_encode(spark, folder):
    decoded = saved_filters.decode_filters(inputs.filter_strings(spark, folder))
    return decoded.select("query_id", saved_filters.encode_filters().alias("query_string"))


@query
def filter_sign_query(spark, folder):
    """Saved filters answered by the batch sign query."""
    tables = curated_tables(spark, folder)
    decoded = saved_filters.decode_filters(inputs.filter_strings(spark, folder))
    asked = saved_filters.to_sign_queries(decoded)
    return S.query_signs_batch(asked, tables.signs, tables.codes).select("query_id", "sign_id")


def _filter_signatures(spark, folder, mode: str = "any", strict: bool = False) -> DataFrame:
    """The codes of each time signature among the saved filters."""
    decoded = saved_filters.decode_filters(inputs.filter_strings(spark, folder))
    index = TimeIndex(curated_tables(spark, folder).codes)
    return index.codes_in(saved_filters.to_sign_queries(decoded), mode, strict)


@query
def signature_codes(spark, folder):
    return _filter_signatures(spark, folder)


@query
def signature_codes_all_mode(spark, folder):
    return _filter_signatures(spark, folder, mode="all")


@query
def signature_codes_strict(spark, folder):
    return _filter_signatures(spark, folder, strict=True)


@query
def filter_sign_query_indexed(spark, folder):
    """Saved filters answered by the batch sign query, each time signature looked up once."""
    tables = curated_tables(spark, folder)
    decoded = saved_filters.decode_filters(inputs.filter_strings(spark, folder))
    asked = saved_filters.to_sign_queries(decoded)
    index = TimeIndex(tables.codes)
    found = S.query_signs_batch(asked, tables.signs, tables.codes, time_index=index)
    return found.select("query_id", "sign_id")


@query
def filter_spot_query(spark, folder):
    decoded = saved_filters.decode_filters(inputs.filter_strings(spark, folder))
    asked = saved_filters.to_spot_queries(decoded)
    answered = SP.query_spots_batch(asked, curated_tables(spark, folder).spots)
    return answered.where("part_no = 0").select("query_id", "place_id", "is_currently_free")


@query
def filter_rejected(spark, folder):
    decoded = saved_filters.decode_filters(inputs.filter_strings(spark, folder))
    return saved_filters.rejected(decoded)


# Output


@query
def cluster_grid(spark, folder):
    return clusters.cluster_points(curated_tables(spark, folder).signs, (10, 13, 16))


@query
def cluster_spots(spark, folder):
    spots = curated_tables(spark, folder).spots.where("part_no = 0")
    return clusters.cluster_points(spots, (12, 17))


CLUSTER_ZOOMS = (14, 16)


@query
def cluster_radius(spark, folder):
    """Spots clustered within the radius of a centre, from the finest level up."""
    spots = curated_tables(spark, folder).spots.where("part_no = 0")
    numbered = spots.withColumn("spot", F.col("place_id").cast("bigint"))
    return radius_clusters(numbered, "spot", CLUSTER_ZOOMS)


@query
def geojson_features(spark, folder):
    found = _asked_signs(spark, folder, "sign_query_time")
    return found.select("sign_id", geojson.sign_feature().alias("feature"))


@query
def geojson_spot_features(spark, folder):
    """Spot features written one per line and read back, one row per description."""
    answered = _asked_spots(spark, folder, "spot_query_free")
    path = new_path(spark, "features")
    geojson.write_features(answered, geojson.spot_feature(), path)
    back = geojson.read_features(spark, path, geojson.SPOT_PROPERTIES)
    return back.withColumn("description", F.explode_outer("periods")).drop("periods")


@query
def geojson_read(spark, folder):
    """Sign features written one per line and read back."""
    found = _asked_signs(spark, folder, "sign_query_reserved")
    path = new_path(spark, "features")
    geojson.write_features(found, geojson.sign_feature(), path)
    return geojson.read_features(spark, path, geojson.SIGN_PROPERTIES)


@query
def geojson_document(spark, folder):
    """Sign features as one document, written by several tasks and read back in pieces."""
    found = _asked_signs(spark, folder, "sign_query_time")
    path = new_path(spark, "document")
    write_document(found, geojson.sign_feature(), path, ["sign_id"])
    return read_document(spark, path, geojson.SIGN_PROPERTIES)


@query
def feature_collections(spark, folder):
    """Collections per batch query, written one per line and read back as rows."""
    tables = curated_tables(spark, folder)
    answers = S.query_signs_batch(inputs.query_rows(spark, folder), tables.signs, tables.codes)
    return _collected(answers, per_collection=10_000)


@query
def feature_collections_split(spark, folder):
    """The same with few features per document, so that most queries have several documents."""
    tables = curated_tables(spark, folder)
    answers = S.query_signs_batch(inputs.query_rows(spark, folder), tables.signs, tables.codes)
    return _collected(answers, per_collection=10)


def _collected(answers, per_collection):
    spark = answers.sparkSession
    documents = geojson.collections(answers, geojson.sign_feature, "query_id", per_collection)
    path = new_path(spark, "collections")
    documents.select("collection").write.text(path)
    return geojson.read_collections(spark, path, geojson.SIGN_PROPERTIES, multi_line=False)


@query
def sign_display(spark, folder):
    found = _asked_signs(spark, folder, "sign_query_all_dimensions")
    return found.select(
        "sign_id",
        display.sign_color(F.col("category")).alias("color"),
        display.sign_popup(F.col("category"), F.col("description")).alias("popup"),
    )


@query
def marker_layers(spark, folder):
    return markers.marker_layers(curated_tables(spark, folder), MARKER_VIEW)


@query
def marker_layers_not(spark, folder):
    return markers.marker_layers(
        curated_tables(spark, folder), MARKER_VIEW, reserved=True, not_in_range=True,
        include_spots=False,
    )


@query
def spot_display(spark, folder):
    answered = _asked_spots(spark, folder, "spot_query_free")
    free, street = F.col("is_currently_free"), F.col("street")
    line = F.explode_outer(F.when(F.size("periods") > 0, F.col("periods"))).alias("line")
    return answered.select("place_id", free, street, line).select(
        "place_id",
        display.spot_color(free).alias("color"),
        display.spot_popup(free, street, F.array("line", F.lit("<>"))).alias("popup"),
    )


@query
def result_cap(spark, folder):
    found = _asked_signs(spark, folder, "sign_query_all_dimensions")
    answered = _asked_spots(spark, folder, "spot_query_free")
    return viewport.result_sizes(found, answered, limit=1_000)

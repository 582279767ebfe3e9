"""Headline queries at one scale factor; prints one JSON line.

Every query is run to the end without fetching rows. Building the curated tables is timed
by itself; the queries after it read them. The value is the sum over the queries.
"""

from __future__ import annotations

import json
import os
import time

from checks.queries import REGISTRY, SIGN_QUERIES
from kerbside.plans.prepared import curated_tables
from kerbside.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "codes_classify",
    "codes_day_ranges",
    "codes_dictionary",
    "spot_periods",
    "interval_matrix",
    "sign_query_time",
    "sign_query_bbox_only",
    "sign_query_all_mode",
    "spot_query_free",
    "spot_labels",
    "batch_sign_query",
    "batch_spot_query",
    "filter_sign_query",
    "filter_sign_query_indexed",
    "cluster_grid",
    "cluster_radius",
    "geojson_features",
    "geojson_document",
    "feature_collections",
    "quality_report",
    "marker_layers",
    "spot_display",
    "csv_read",
    "via_regulations",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stage_totals(spark, name: str, df) -> dict[str, int]:
    """Bytes shuffled and rows scanned by one run of a query."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    run(df)
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {i for job in tracker.getJobIdsForGroup(name) for i in tracker.getJobInfo(job).stageIds}
    totals = {"shuffle_bytes": 0, "rows_scanned": 0}
    for stage in stages:
        data = store.lastStageAttempt(stage)
        totals["shuffle_bytes"] += data.shuffleWriteBytes()
        totals["rows_scanned"] += data.inputRecords()
    return totals


def warm_median(spark, name: str, runs: int = 7) -> float:
    return sorted(timed(lambda: run(REGISTRY[name](spark, FOLDER))) for _ in range(runs))[runs // 2]


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    spark = local_session(CPUS, "kerbside-bench")
    run(REGISTRY["moment_query"](spark, FOLDER))  # start the session's workers

    seconds = {"build_curated": timed(lambda: curated_tables(spark, FOLDER))}
    for name in HEADLINE:
        seconds[name] = timed(lambda: run(REGISTRY[name](spark, FOLDER)))

    tables = curated_tables(spark, FOLDER)
    singles = {name: warm_median(spark, name) for name in ("sign_query_bbox_only", "spot_query_free")}
    viewport = stage_totals(spark, "viewport", REGISTRY["sign_query_bbox_only"](spark, FOLDER))
    box = SIGN_QUERIES["sign_query_bbox_only"][0].bbox
    files = len(tables.sign_slices.met_by(box)), len(tables.sign_slices.files)
    links = stage_totals(spark, "links", REGISTRY["spot_periods"](spark, FOLDER))
    signs, queries = tables.signs.count(), spark.read.parquet(f"{FOLDER}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "signs": signs,
                "signs_built_per_sec": round(signs / seconds["build_curated"]),
                "batch_queries_per_sec": round(queries / seconds["batch_sign_query"]),
                "single_query_warm_sec": singles,
                "viewport_rows_scanned": viewport["rows_scanned"],
                "viewport_files_opened": files[0],
                "sign_files": files[1],
                "period_join_shuffle_bytes": links["shuffle_bytes"],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
